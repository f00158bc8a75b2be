"""Patient-cluster bootstrap by counts: how often each patient is drawn, without a table of slots.

A draw of all slots of a task is split over ranges of patients: half of a range gets a binomial share of its
slots, down to blocks of bounded size, and inside a block the slots fall on its patients evenly.  Every split has its own
random numbers, keyed by (seed, task, draw, range), so any task can work out the slots of any run of blocks on its own, in about as
many steps as the run has blocks, and all blocks of a draw agree.

The confusion cells of a block of patients meet the counts as a matrix product, so a draw leaves the task as one sum per
distinct cell and run of blocks.  The slot table of ``bootstrap`` has the same distribution, but other values; it stays for the SQL checks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Patients of a block, blocks and draws of one group of the shuffle, draws multiplied at a time.
BLOCK, RUN, DRAWS, STEP = 16_384, 16, 1000, 32

# One bit generator a process: keyed anew it costs a fraction of a new one, which asks the system for entropy first.
_PHILOX = np.random.Philox(key=0)
_GENERATOR, _FRESH = np.random.Generator(_PHILOX), _PHILOX.state


def _random(*key: object) -> np.random.Generator:
    """The random numbers of ``key`` from their start; they end with the next call."""
    digest = blake2b(":".join(map(str, key)).encode(), digest_size=16).digest()
    _PHILOX.state = _FRESH | {"state": {"counter": _FRESH["state"]["counter"], "key": np.frombuffer(digest, "<u8")}}
    return _GENERATOR


def run_slots(task: str, draw: int, first: int, last: int, patients: int, size: int = BLOCK, seed: int = 0) -> list[int]:
    """Slots of a draw that fall on each of the blocks ``first`` to ``last`` (excluded); splits that blocks share are made once."""
    found, ranges = [], [(0, -(-patients // size), patients)]
    while ranges:
        lo, hi, slots = ranges.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            found.append(slots)
            continue
        middle = (lo + hi) // 2
        left, whole = (middle - lo) * size, min(hi * size, patients) - lo * size
        share = int(_random(seed, task, draw, lo, hi).binomial(slots, left / whole))
        ranges += [(middle, hi, slots - share), (lo, middle, share)]
    return found


def block_slots(task: str, draw: int, block: int, patients: int, size: int = BLOCK, seed: int = 0) -> int:
    """Slots of a draw that fall on a block of patients; over all blocks they add up to ``patients``."""
    return run_slots(task, draw, block, block + 1, patients, size, seed)[0]


def _fall(task: str, draw: int, block: int, own: int, slots: int, seed: int) -> np.ndarray:
    return np.bincount(_random(seed, task, draw, block).integers(0, own, slots), minlength=own)


def block_counts(task: str, draw: int, block: int, patients: int, size: int = BLOCK, seed: int = 0) -> np.ndarray:
    """How often each patient of a block is drawn."""
    own = min((block + 1) * size, patients) - block * size
    return _fall(task, draw, block, own, block_slots(task, draw, block, patients, size, seed), seed)


def _sums(patients: Mapping[str, int], replicates: int, size: int, seed: int, run: int, together: int):
    """Sums per (draw, cell) over rows that come group by group: the blocks of one (task, run of blocks, range of draws)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                task, block, first = (row[k].as_py() for k in ("task", "block", "first"))
                if (task, block // run, first) != at:
                    yield from _made(at, sums)
                    at, sums = (task, block // run, first), {}
                    draws = range(first, min(first + together, replicates))
                    start = block // run * run
                    slots = [run_slots(task, d, start, start + run, patients[task], size, seed) for d in draws]
                codes, code = np.unique(row["cells"].values.to_numpy(), return_inverse=True)
                own = min((block + 1) * size, patients[task]) - block * size
                matrix = np.bincount(row["places"].values.to_numpy().astype(np.int64) * len(codes) + code, row["ns"].values.to_numpy(),
                                     own * len(codes)).reshape(own, len(codes))
                most = max(s[block - start] for s in slots) * matrix.max(initial=0)
                # Whole numbers, exact in single precision below 2^24, as nearly always.
                kind = np.float32 if most < 1 << 24 else np.float64
                matrix = matrix.astype(kind)
                total = np.empty((len(draws), len(codes)), np.int64)
                counts = np.empty((STEP, own), kind)
                for lo in range(0, len(draws), STEP):
                    held = draws[lo:lo + STEP]
                    for j, d in enumerate(held):
                        counts[j] = _fall(task, d, block, own, slots[lo + j][block - start], seed)
                    total[lo:lo + len(held)] = np.rint(counts[:len(held)] @ matrix)
                for j, c in enumerate(codes.tolist()):
                    sums[c] = sums.get(c, 0) + total[:, j]
        yield from _made(at, sums)
    return work


def _made(at: tuple | None, sums: Mapping[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        draws = len(next(iter(sums.values())))
        yield pa.RecordBatch.from_pydict({"draw": pa.array(np.tile(np.arange(at[2], at[2] + draws), len(sums)).astype(np.int64)),
                                          "cell": pa.array(np.repeat(np.array(list(sums), np.int32), draws)),
                                          "n": pa.array(np.concatenate(list(sums.values())))})


def resampled_confusions(cells: DataFrame, patients: Mapping[str, int], replicates: int, by: Sequence[str] = ("task", "method"),
                         seed: int = 0, size: int = BLOCK, run: int = RUN, together: int = DRAWS) -> DataFrame:
    """Confusion cells per draw, as ``bootstrap.resampled_confusions`` gives them from a slot table.

    ``cells`` has (task, method, patient_index, truth, predicted, n) and is read twice, so pass a stored table; ``patients`` has the
    number of patients per task, whose positions go from 0.  All methods of a task share its draws.  A cell that no drawn patient
    has counts zero.  A task without patients has no rows.
    """
    labels = [*by, "truth", "predicted"]
    # At most tasks x methods x classes^2 distinct cells.
    codes = cells.select(*labels).distinct().withColumn("cell", F.row_number().over(Window.orderBy(*labels)))
    held = cells.join(codes, labels).select("task", F.expr(f"patient_index div {size}").alias("block"),
                                            F.struct((F.col("patient_index") % size).cast("int").alias("place"), "cell", "n").alias("e"))
    # A block has ``size`` patients and their cells, so a group is bounded.
    packed = held.groupBy("task", "block").agg(F.array_agg("e").alias("e")).select(
        "task", "block", F.col("e.place").alias("places"), F.col("e.cell").alias("cells"), F.col("e.n").alias("ns"))
    spread = packed.select("*", F.expr(f"block div {run}").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(together))).alias("first"))
    groups = sum(-(-n // (size * run)) for n in patients.values()) * -(-replicates // together)
    group = ["task", "run", "first"]
    dealt = spread.repartition(max(1, groups), *group).sortWithinPartitions(*group, "block")
    sums = dealt.mapInArrow(_sums(dict(patients), replicates, size, seed, run, together), "draw long, cell int, n long")
    return sums.groupBy("draw", "cell").agg(F.sum("n").alias("n")).join(codes, "cell").select("draw", *labels, "n")
