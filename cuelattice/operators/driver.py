"""Plug-in models at work: models kept by workers, batches that shrink and grow, rows of failures, devices, pilots.

A worker process serves many tasks one after another; ``kept`` gives all of them the same loaded model. A stage that needs devices says
so by a resource profile (``devices``), and one whose model spans several tasks by ``barrier``. Rows that could not be scored come back with
an ``error``, so that nothing is lost and a run can be taken up by ``infer.unfinished``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import answers
from cuelattice.operators.infer import yield_rate
from cuelattice.operators.sampling import sample_by_group
from cuelattice.plans.session import ship_code

#: Rows scored at once, further tries of a single row, cues and generations of a pilot.
BATCH, TRIES, PILOT_CUES, PILOT_SAMPLES = 128, 3, 50, 100
#: Failures that a smaller batch may mend.
MENDABLE = (MemoryError, RuntimeError)

_KEPT: OrderedDict[str, tuple[Any, int]] = OrderedDict()


def kept(key: str, load: Callable[[], Any], size: Callable[[Any], int] = lambda _: 1, most: int = 1) -> Any:
    """What ``load`` gives, loaded once for a worker and ``key``; those longest unused go while all sizes sum up to over ``most``.

    The one asked for stays whatever its size.
    """
    if key in _KEPT:
        _KEPT.move_to_end(key)
        return _KEPT[key][0]
    made = load()
    _KEPT[key] = (made, size(made))
    while len(_KEPT) > 1 and sum(n for _, n in _KEPT.values()) > most:
        _KEPT.popitem(last=False)
    return made


def devices(amount: int = 1, cores: int = 1, resource: str = "gpu", script: str = "", memory: str | None = None) -> ResourceProfile:
    """A profile for a stage: each task has ``amount`` devices (a share of one, if below 1) and ``cores`` cores."""
    own = ExecutorResourceRequests().cores(cores).resource(resource, max(1, int(amount)), script)
    if memory:
        own = own.memory(memory)
    return ResourceProfileBuilder().require(own).require(TaskResourceRequests().cpus(cores).resource(resource, amount)).build


def careful(call: Callable[[pd.DataFrame], list], pdf: pd.DataFrame, batch: int = BATCH, tries: int = TRIES, mendable: tuple = MENDABLE) -> Iterator[tuple[pd.DataFrame, list, str | None]]:
    """(rows, results, error) for all rows of ``pdf`` in order: batches are halved when they fail and doubled when they succeed.

    A single row that fails ``tries`` more times comes with no results and the failure's text, and the next batch has full size
    again. Failures that are not ``mendable`` are raised.
    """
    at, size, left = 0, batch, tries
    while at < len(pdf):
        part = pdf.iloc[at : at + size]
        try:
            got = call(part)
        except mendable as e:
            if len(part) > 1:
                size = max(1, len(part) // 2)
            elif left:
                left -= 1
            else:
                yield part, [None], f"{type(e).__name__}: {e}"
                at, size, left = at + 1, batch, tries
            continue
        yield part, got, None
        at, size, left = at + len(part), min(batch, size * 2), tries


def scored(
    rows: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], name: str | None = None, batch: int = BATCH, tries: int = TRIES, prompt: str = "prompt", response: str = "response_set",
    profile: ResourceProfile | None = None, barrier: bool = False, progress=None,
) -> DataFrame:
    """``rows`` with token_log_probs and error, by a scorer of (prompts, responses): every row comes back, scored or with its failure.

    ``name`` keeps the scorer in its worker from task to task; ``progress`` is an accumulator of rows done. With ``barrier`` all tasks
    of the stage start together, as a model on several devices needs it.
    """
    ship_code(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = kept(name, make) if name else make()
        call = lambda part: scorer(part[prompt].tolist(), part[response].tolist())
        for pdf in batches:
            for part, got, error in careful(call, pdf, batch, tries):
                if progress is not None:
                    progress.add(len(part))
                yield part.assign(token_log_probs=got, error=error)

    return rows.mapInPandas(run, f"{schema}, token_log_probs array<double>, error string", barrier, profile)


def pilot(cues: DataFrame, models: dict[str, Callable[[], Callable[[list[str]], list[str]]]], n_cues: int = PILOT_CUES, samples: int = PILOT_SAMPLES, cue: str = "cue", prompt: str = "prompt") -> DataFrame:
    """(model, status, n_generations, yield_rate, verdict): a trial of every model on ``n_cues`` cues picked by md5.

    Generations that fail are left out and end the work on their cue. The status is LOAD_FAIL for a model that cannot be made, FAILED for one without any
    generation, else SUCCESS; the yield is the share of generations with three answers, and the verdict PASS from one half on.
    """
    ship_code(cues.sparkSession)
    picked = sample_by_group(cues.select(cue, prompt).distinct().withColumn("__one", F.lit(1)), ["__one"], [cue], n_cues).select(cue, prompt)

    def trial(name: str, make):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            generator, why = None, ""
            try:
                generator = make()
            except Exception as e:  # whatever keeps a model from being loaded is its report
                why = f"load: {e}"
            for pdf in batches:
                for text in pdf[prompt]:
                    done: list[str] = []
                    error = why or None
                    while generator is not None and len(done) < samples and error is None:
                        try:
                            done += generator([text] * min(10, samples - len(done)))
                        except MENDABLE as e:
                            error = str(e)
                    yield pd.DataFrame({"model": name, "text": [*done, None], "error": [*[None] * len(done), error]})

        return picked.mapInPandas(run, "model string, text string, error string")

    every = None
    for name, make in sorted(models.items()):
        every = trial(name, make) if every is None else every.unionByName(trial(name, make))
    rated = yield_rate(every.filter("text is not null").withColumn("responses", answers(F.col("text"))), ["model"])
    seen = every.groupBy("model").agg(F.max(F.col("error").startswith("load:")).alias("bad"))
    out = seen.join(rated, "model", "left")
    status = F.when(F.coalesce("bad", F.lit(False)), "LOAD_FAIL").when(F.col("n_generations").isNull(), "FAILED").otherwise("SUCCESS")
    return out.select("model", status.alias("status"), F.coalesce("n_generations", F.lit(0).cast("long")).alias("n_generations"), F.coalesce("yield_rate", F.lit(0.0)).alias("yield_rate"), F.coalesce(F.col("status"), F.lit("FAIL")).alias("verdict"))
