"""Text expressions: keys, responses, generated answers, names of models and embeddings.

All are built-in functions, so they stay in the JVM; a null gives a null unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: white space, Unicode separators included.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed pattern of a decimal number; engines' own casts accept more.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Fixed lists of the answer parser: refusals and words that are no answers.
REFUSALS = ("i cannot", "as an ai", "sorry", "model", "language model")
NO_ANSWERS = ("sure", "here", "association")
#: Fixed list: the models of limited mode, in both spellings.
CORE_MODELS = ["gpt-oss-20b-instruct", "gpt-oss-20-b-instruct", "mistral-small-24b-instruct", "mistral-small-24-b-instruct", "gemma-3-27b-instruct", "gemma-3-27-b-instruct", "qwen-3-32b-instruct", "qwen-3-32-b-instruct"]
#: Fixed table: the rating file of each embedding key; every variant is scored with its model's ratings.
OWN_RATING_FILES = {
    "passive_gemma-3-27-b-instruct": "gemma-3-27b-instruct",
    "passive_gemma-3-27-b-instruct_shuffled": "gemma-3-27b-instruct",
    "passive_gemma-3-27-b-instruct_contrast": "gemma-3-27b-instruct",
    "passive_gpt-oss-20-b-instruct": "gpt-oss-20b-instruct",
    "passive_gpt-oss-20-b-instruct_shuffled": "gpt-oss-20b-instruct",
    "passive_gpt-oss-20-b-instruct_contrast": "gpt-oss-20b-instruct",
    "passive_mistral-small-24-b-instruct": "mistral-small-24b-instruct",
    "passive_mistral-small-24-b-instruct_shuffled": "mistral-small-24b-instruct",
    "passive_mistral-small-24-b-instruct_contrast": "mistral-small-24b-instruct",
    "passive_qwen-3-32-b-instruct": "qwen-3-32b-instruct",
    "passive_qwen-3-32-b-instruct_shuffled": "qwen-3-32b-instruct",
    "passive_qwen-3-32-b-instruct_contrast": "qwen-3-32b-instruct",
}
#: Fixed list: the embedding types that are compared.
WANTED_TYPES = ("Baseline", "Activation", "Behavior_Contrastive", "Behavior_Standard", "Behavior_Contrastive_300d", "Behavior_Standard_300d")
#: Fixed table of display names.
DISPLAY = {"gemma-3-27b": "Gemma 3 27B", "gpt-oss-20b": "GPT-OSS 20B", "mistral-small-24b": "Mistral 24B", "qwen-3-32b": "Qwen 3 32B"}


def stripped(c: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(c, F.lit(SPACES))


def word_key(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return stripped(F.lower(c))


def number(c: Column) -> Column:
    """The double a text stands for, or null; ``nan``, ``1_000`` and ``1d`` are no numbers."""
    plain = F.trim(c)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def letters_and_spaces(c: Column) -> Column:
    """Letters, digits and white space of the lower-cased text, stripped (how generated answers are matched)."""
    return stripped(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""))


def safe_name(c: Column) -> Column:
    """A file name: letters, digits and ._- stay, anything else becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def without_separators(c: Column) -> Column:
    """The text without commas and white space, for comparing scored with intended text."""
    return F.translate(c, ", \t\n\r", "")


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether any of ``parts`` occurs; null counts as no."""
    return F.coalesce(reduce(Column.__or__, [c.contains(p) for p in parts], F.lit(False)), F.lit(False))


def contains_text(c: Column, part: str) -> Column:
    """Case-insensitive substring test; null counts as no."""
    return F.coalesce(c.ilike(f"%{part}%"), F.lit(False))


def response_set(*columns: Column) -> Column:
    """Non-null responses, lower-cased and stripped, joined by ', '."""
    return F.concat_ws(", ", *(word_key(c) for c in columns))


def filled(template: Column, word: Column, mark: str = "{word}") -> Column:
    """A prompt template with the word put in for its mark."""
    return F.replace(template, F.lit(mark), word)


def json_line(*columns: Column | str) -> Column:
    """A row as a JSON object in the order of its columns; nulls stay, as ``null``."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def csv_cell(c: Column, numeric: bool = False) -> Column:
    """A hand-written CSV cell: texts quoted with doubled quotes, numbers bare, null as NA, whole numbers without a point."""
    if numeric:
        return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string")), F.lit("NA"))
    return F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("NA"))


def answers(c: Column, most: int = 3) -> Column:
    """The first ``most`` distinct words of a generated text; a refusal has none.

    Lower case; what stands before the last ``</think>`` goes; line ends part words as commas do; a list mark at the start
    goes; only letters, digits, hyphens and spaces stay. The refusal test comes first and sees the whole text.
    """
    low = word_key(c)
    body = F.substring_index(low, "</think>", -1)
    body = F.regexp_replace(body, r"[\n\r]", ",")
    body = F.regexp_replace(F.regexp_replace(body, r"^\d+\.\s*", ""), r"^-\s*", "")
    words = F.transform(F.split(body, ","), lambda p: F.trim(F.regexp_replace(stripped(p), r"[^\p{L}\p{N}\- ]", "")))
    kept = F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*NO_ANSWERS)))
    refused = reduce(Column.__or__, [low.contains(x) for x in REFUSALS])
    return F.when(refused, F.array().cast("array<string>")).otherwise(F.slice(kept, 1, most))


# --- names ----------------------------------------------------------------------------------------------------------


def model_name(c: Column) -> Column:
    """One spelling of a model's name: suffixes off, lower case, hyphens, and a hyphen between letters and digits."""
    name = F.replace(F.replace(c, F.lit("-deranged-results"), F.lit("")), F.lit("-results"), F.lit(""))
    name = F.regexp_replace(word_key(name), "[ _]", "-")
    name = F.regexp_replace(F.regexp_replace(name, "([a-z])([0-9])", "$1-$2"), "([0-9])([a-z])", "$1-$2")
    return F.regexp_replace(name, "-{2,}", "-")


def _base(c: Column) -> Column:
    return F.regexp_replace(c, "^(passive_|activation_|active_)", "")


def source_model(c: Column) -> Column:
    """The normalised model that an embedding key was made from, whatever its modality, variant or width."""
    return model_name(F.regexp_replace(F.regexp_replace(_base(c), "_300d$", ""), "(_contrast|_shuffled)$", ""))


def sweep_name(c: Column) -> Column:
    """The key without its modality, with ``27-b-`` spelled ``27b-``."""
    return F.replace(_base(c), F.lit("-b-"), F.lit("b-"))


def bare_name(c: Column) -> Column:
    """The key without modality and variant, underscores as hyphens."""
    return F.replace(F.regexp_replace(_base(c), "_contrast|_shuffled|_300d", ""), F.lit("_"), F.lit("-"))


def size_name(c: Column) -> Column:
    """The name with a ``-b`` at its end joined to the number before it."""
    return F.regexp_replace(c, "-b$", "b")


def joined_name(c: Column) -> Column:
    """The key of loosest comparison: no tuning tag, no hyphen, no underscore."""
    return F.regexp_replace(c, "-instruct|-base|[-_]", "")


def display_name(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(c, "-instruct|-base", ""), "^[-_]+|[-_]+$", "")
    known = F.coalesce(*(F.when(base == k, F.lit(v)) for k, v in DISPLAY.items()))
    return F.coalesce(known, F.initcap(F.regexp_replace(base, "[-_]", " ")))


def key_model(c: Column) -> Column:
    """The model that an embedding key names: ``Human``, the model, or ``Unknown``."""
    passive = F.regexp_replace(c, "passive_|-instruct|_300d", "")
    passive = F.when(c.contains("_contrast"), F.replace(passive, F.lit("_contrast"), F.lit(""))).otherwise(F.replace(passive, F.lit("_shuffled"), F.lit("")))
    return F.when(c == "human_matrix", "Human").when(c.startswith("activation_"), F.regexp_replace(c, "activation_|-instruct", "")).when(c.startswith("passive_"), passive).otherwise("Unknown")


def key_type(c: Column) -> Column:
    """The embedding type that a key names."""
    variant = F.when(c.contains("_contrast"), "Behavior_Contrastive").when(c.contains("_shuffled"), "Behavior_Shuffled").otherwise("Behavior_Standard")
    behavior = F.concat(variant, F.when(c.contains("_300d"), "_300d").otherwise(""))
    return F.when(c == "human_matrix", "Baseline").when(c.startswith("activation_"), "Activation").when(c.startswith("passive_"), behavior).otherwise("Unknown")


def tuned(c: Column, hub: Column | None = None) -> Column:
    """Whether a model is instruction-tuned, by its key or its hub name; for orders that put tuned models first."""
    own = F.lower(c).contains("instruct")
    return own if hub is None else own | F.coalesce(F.lower(hub).contains("instruct"), F.lit(False))


def allowed(c: Column, names: list[str] | None) -> Column:
    """Whether a model is to be worked on: all are without a list."""
    return F.lit(True) if names is None else c.isin(names)
