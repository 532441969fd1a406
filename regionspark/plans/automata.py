"""Finite automata over the sorted rows of a key, split where a key is hot.

A range sort by key and order cuts a long log into stretches in several partitions. What a stretch does to the automaton is a
function of its state, and such functions compose associatively: each row carries the composition of its stretch so far, each
partition passes on the two functions at its ends, and the states in which stretches start follow from these, one row a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionspark.session import written


class Machine:
    """moves[symbol][state] is the next state; state 0 starts every key."""

    def __init__(self, moves: Sequence[Sequence[int]]):
        self.moves = [tuple(m) for m in moves]
        self.same = tuple(range(len(self.moves[0])))
        if any(len(m) != len(self.same) or not set(m) <= set(self.same) for m in self.moves):
            raise ValueError("a move leads from every state to a state")


def _composed(machine: Machine, at: tuple[int, ...], symbol: int, known: dict) -> tuple[int, ...]:
    if (out := known.get((at, symbol))) is None:
        move = machine.moves[symbol]
        out = known[at, symbol] = tuple(move[s] for s in at)
    return out


def states_before(df: DataFrame, keys: list[str], order: list[str], symbol: Column, machine: Machine, out: str = "state") -> DataFrame:
    """df with `out`: the state of the automaton before each row, in the given order of the rows of its key.

    Keys may be null; equal order values of a key come in any order, so give enough columns. Two passes over the rows, none of
    which holds a key's log: the sorted rows are written once, with the function of each row's stretch where the stretch may
    have begun in an earlier partition.
    """
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), symbol.cast("int").alias("symbol"))
    packed = packed.repartitionByRange("key", *[F.col(f"row.`{c}`") for c in order]).sortWithinPartitions("key", *[F.col(f"row.`{c}`") for c in order])
    marked = T.StructType([*packed.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("path", T.ArrayType(T.ByteType())), T.StructField("after", T.ArrayType(T.ByteType())), T.StructField("first", T.BooleanType()), T.StructField("edge", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, first, at, known, held = TaskContext.get().partitionId(), None, True, machine.same, {}, None

        def made(batch: pa.RecordBatch, path, after, firsts, edges) -> pa.RecordBatch:
            columns = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(path, pa.list_(pa.int8())), pa.array(after, pa.list_(pa.int8())), pa.array(firsts, pa.bool_()), pa.array(edges, pa.bool_())]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=marked.names)

        for batch in batches:
            path, after, firsts, edges = [], [], [], []
            begun = own is None
            for key, sym in zip(batch.column("key").to_pylist(), batch.column("symbol").to_pylist()):
                if begun:
                    own, begun = key, False
                elif key != own:
                    if edges:
                        edges[-1] = edges[-1] or first
                    elif held:
                        held[-1][-1] = held[-1][-1] or first
                    own, first, at = key, False, machine.same
                path.append(at if first else at[:1])
                at = _composed(machine, at, sym, known)
                after.append(at if first else at[:1])
                firsts.append(first)
                edges.append(False)
            if batch.num_rows:
                if held:
                    yield made(*held)
                held = (batch, path, after, firsts, edges)
        if held:
            held[-1][-1] = True
            yield made(*held)

    rows = written(packed.mapInArrow(run, marked))
    ends = rows.where("edge").select("part", "key", "after", "first").orderBy("part", F.desc("first")).collect()  # two rows a partition at most
    starts, key, state = {}, None, 0
    for r in ends:
        if r["first"]:
            starts[r["part"]] = state = state if r["key"] == key and key is not None else 0
            state = r["after"][state]
        else:
            state = r["after"][0]
        key = r["key"]
    begun = df.sparkSession.createDataFrame(list(starts.items()), "part int, start int")  # a row a partition
    start = F.when(F.col("first"), F.col("start")).otherwise(F.lit(0))
    joined = rows.join(F.broadcast(begun), "part", "left")
    return joined.select("row.*", F.get("path", start).cast("int").alias(out))


# --- the order of stages ----------------------------------------------------------------------------------------------


def stage_machine(stages: Sequence[str]) -> Machine:
    """States 0 .. n + 1: how many advances there were (n + 1: more than all), n + 2: over. Symbols 0 .. n - 1: an advance that
    names that stage, n: one that names none, n + 1: complete, n + 2: another end, n + 3: anything else."""
    n = len(stages)
    over = n + 2
    advance = [min(s + 1, n + 1) for s in range(n + 2)] + [over]
    return Machine([*[advance] * (n + 1), [over] * (n + 3), [over] * (n + 3), range(n + 3)])


def stage_symbol(event: Column, stage: Column, stages: Sequence[str]) -> Column:
    n = len(stages)
    known = F.coalesce(*[F.when(stage == s, F.lit(i)) for i, s in enumerate(stages)], F.lit(n))
    return F.when(event == "advance", known).when(event == "complete", n + 1).when(event.isin("cancel", "fail"), n + 2).otherwise(n + 3)


def stage_broken(state: Column, symbol: Column, stages: Sequence[str]) -> Column:
    """Whether an event in this state breaks the order: an advance must name the next stage, complete needs all, and nothing
    may follow an end."""
    n = len(stages)
    return (state == n + 2) | (symbol <= n) & (symbol != state) | (symbol <= n) & (state >= n) | (symbol == n + 1) & (state != n)
