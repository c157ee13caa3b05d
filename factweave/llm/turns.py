"""Repair of conversations by a scan of 4x4 matrices in the (cost, audit) semiring.

A repaired conversation's roles are, by their initials, `(s?(ua)+)?`.  That is an
automaton of four states: nothing yet, after system, after user, after assistant.
A turn is the matrix of what its edits cost from state to state, each entry being
the least (cost, edits); inserted turns are the closure of the insertions alone,
multiplied before each turn and once after the last.  So each entry of a product
ends with the letter of a turn, no entry is the beginning of one it is compared
with, and taking the least commutes with appending: the product is associative.

Rows are sorted by range of (conv_id, turn), so that a long conversation lies in
many partitions.  A task cuts its rows into pieces of up to PIECE turns and
multiplies each piece's matrices as a tree.  A conversation inside one task is
done there; pieces of the others are multiplied in levels of at most FAN by
shuffles of matrices alone.  Then each piece gets its part of the edits.  A
digest of a whole conversation is sequential: it streams through one task, a
piece at a time.

A null role or text is one space; a null conv_id is a conversation of its own; a
null turn comes first.  Rows of one turn come in order of role, of their text's
first 64 characters and of its hash, equal ones side by side.  A role that doesn't
begin with s, u or a, and an empty one, can't be kept.  Texts are in memory a
piece at a time, a longer one as a whole.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import exchange as X

Entry = tuple[int, str] | None
Matrix = list[list[Entry]]

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: State that a role's initial leads to, and the states it may follow.
MOVES = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: White space of the words `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns and bytes of a piece, and matrices multiplied in one task at a level.
PIECE, PIECE_BYTES, FAN = 2048, 2 << 20, 8
STATS = ("n_rows", "blank", "duplicate", "truncated", "illegal")


def times(a: Matrix, b: Matrix) -> Matrix:
    """Of each way over a state between, the least cost and of equal ones the least edits."""
    out: Matrix = []
    for row in a:
        mine: list[Entry] = []
        for j in range(4):
            cost, edits = None, ""
            for x, other in zip(row, b):
                y = other[j]
                if x is None or y is None:
                    continue
                both = x[0] + y[0]
                if cost is None or both < cost:
                    cost, edits = both, x[1] + y[1]
                elif both == cost:
                    edits = min(edits, x[1] + y[1])
            mine.append(None if cost is None else (cost, edits))
        out.append(mine)
    return out


def plus(a: Matrix, b: Matrix) -> Matrix:
    return [[min((z for z in (x, y) if z is not None), default=None) for x, y in zip(p, q)] for p, q in zip(a, b)]


def identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def _arcs(cost: int, edit: str, initial: str) -> Matrix:
    to, after = MOVES[initial]
    return [[(cost, edit) if j == to and i in after else None for j in range(4)] for i in range(4)]


def insertions() -> Matrix:
    """Any number of inserted user and assistant turns; no state is reached cheaper by more than three."""
    one, out = plus(_arcs(INSERT_COST, INSERT, "u"), _arcs(INSERT_COST, INSERT, "a")), identity()
    for _ in range(3):
        out = plus(identity(), times(out, one))
    return out


@lru_cache(None)
def _turn(code: str) -> Matrix:
    """A turn's matrix behind the insertions before it, by its code."""
    initial, fault = code[0], int(code[1])
    out: Matrix = [[(DELETE_COST, DELETE) if i == j else None for j in range(4)] for i in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for role in "ua":
            out = plus(out, _arcs(REROLE_COST + more, REROLE, role))
        if initial in MOVES:
            out = plus(out, _arcs(more, KEEP, initial))
    return times(insertions(), out)


@lru_cache(1 << 16)
def _few(codes: str) -> Matrix:
    return _turn(codes) if len(codes) == 2 else times(_few(codes[:2]), _few(codes[2:]))


def product(matrices: list[Matrix]) -> Matrix:
    """All of them as a balanced tree."""
    while len(matrices) > 1:
        matrices = [times(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else identity()


def scanned(codes: str) -> Matrix:
    """The product for turns of two characters each: role's initial and fault."""
    return product([_few(codes[i : i + 8]) for i in range(0, len(codes), 8)])


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and edits that lead from nothing to nothing or to an assistant's turn."""
    row = times(whole[:1], insertions())[0]
    return min(x for x in (row[0], row[3]) if x is not None)


def repaired(edits: str, turns: Iterable[tuple[str, str]], place: int, system: bool) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that edits leave; place: how many come before; system: whether the first of all is one."""
    turns = iter(turns)
    for edit in edits:
        if edit == DELETE:
            next(turns)
            continue
        due = ROLES["ua"[(place - system) % 2]]
        if edit == INSERT:
            yield edit, due, ""
        else:
            role, text = next(turns)
            yield edit, role if edit == KEEP else due, text
        place += 1


def _system(edits: str) -> bool:
    """Whether the repaired conversation begins with a system turn: only then is its length odd."""
    return (len(edits) - edits.count(DELETE)) % 2 == 1


def parts(edits: str, sizes: list[int]) -> list[str]:
    """The edits of pieces of so many turns each; insertions belong to the turn behind them, the last ones to the last piece."""
    out, at = [], 0
    for i, n in enumerate(sizes):
        begin = at
        while n:
            n -= edits[at] != INSERT
            at += 1
        out.append(edits[begin : len(edits) if i == len(sizes) - 1 else at])
    return out


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, fault): every row with its first fault, equal rows counted by copy."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    bare = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumn("end", F.substring(bare, -1, 1)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = rows.where("end <> ''").groupBy("conv_id", "role", "text").agg(F.min("when").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(*(F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "text")), "first")
    same = F.col("conv_id").eqNullSafe(F.col("first_conv_id")) & (F.col("role") == F.col("first_role")) & (F.col("text") == F.col("first_text"))
    rows = rows.join(first, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    fault = (
        F.when(F.col("end") == "", BLANK).when((F.col("copy") > 1) | F.coalesce(F.col("when") > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    return rows.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


def _stats(turns: list, roles: list[str], found: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {
        "n_rows": len(roles), "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(TRUNCATED),
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
        "low": known[0] if known else None, "high": known[-1] if known else None, "distinct": len(set(known)),
    }


def _joined_stats(a: dict, b: dict) -> dict:
    """Of two neighbouring stretches."""
    out = {k: a[k] + b[k] for k in STATS}
    out["illegal"] += (a["last"], b["first"]) not in LEGAL
    out |= {"first": a["first"], "last": b["last"], "low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"]}
    return out | {"distinct": a["distinct"] + b["distinct"] - (a["high"] is not None and a["high"] == b["low"])}


def _report(stats: dict, cost: int, edits: str) -> dict:
    gaps = stats["high"] - stats["low"] + 1 - stats["distinct"] if stats["low"] is not None else 0
    return {"gaps": gaps} | {k: stats[k] for k in STATS} | {"cost": cost, "audit": edits}


REPORT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _typed(key: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string(ddl).fields])


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Neighbouring rows with equal keys."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _scan(rows: DataFrame, key: T.DataType, digest: bool) -> DataFrame:
    """Pieces in order of `at`, with the turns' data; `whole` if they are a conversation, then with the digest instead where that is wanted.

    The first and the last conversation of a task may go on in others, so they are never whole.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-X.input_bytes(rows) // (64 << 20)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("copy")]
    ranged = faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, began, conv, held, waiting, own, size = TaskContext.get().partitionId() << 32, 0, None, [], 0, [], 0

        def cut(whole: bool = False) -> None:
            nonlocal at, own, size, waiting
            turns, roles, texts, found = (list(x) for x in zip(*own))
            matrix = scanned("".join(f"{r[:1] if r[:1] in MOVES else '-'}{f}" for r, f in zip(roles, found)))
            made = {"conv_id": conv, "whole": whole, "at": at, "stats": json.dumps(_stats(turns, roles, found)), "matrix": json.dumps(matrix)}
            if whole and digest:
                edits = cheapest(matrix)[1]
                lines = (f"{role}:{text}" for _, role, text in repaired(edits, zip(roles, texts), 0, _system(edits)))
                made["sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            else:
                made["data"] = X.pack(pa.table({"role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())}))
            held.append(made)
            waiting += len(made.get("data", b"")) + 4096
            at, own, size = at + 1, [], 0

        def out() -> pa.RecordBatch:
            nonlocal waiting
            part, waiting = pa.RecordBatch.from_pylist(held, schema), 0
            held.clear()
            return part

        schema, pieces = None, 0
        for batch in batches:
            schema = schema or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), ("whole", pa.bool_()), ("at", pa.int64()), ("stats", pa.string()), ("matrix", pa.string()), ("data", pa.binary()), ("sha256", pa.string())])
            convs, *columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))
            for now, row in zip(convs, zip(*columns)):
                if not began or now != conv:
                    if own:
                        cut(whole=began > 1 and not pieces)
                    began, pieces, conv = began + 1, 0, now
                own.append(row)
                size += len(row[2])
                if len(own) >= PIECE or size >= PIECE_BYTES:
                    cut()
                    pieces += 1
                if waiting >= PIECE_BYTES:
                    yield out()
        if own:
            cut()
        if held:
            yield out()

    return ranged.mapInArrow(run, _typed(key, "whole boolean, at long, stats string, matrix string, data binary, sha256 string"))


def _matrix(said: str) -> Matrix:
    return [[x and tuple(x) for x in row] for row in json.loads(said)]


def _levels(pieces: DataFrame, key: T.DataType, tasks: int) -> DataFrame:
    """(conv_id, stats, matrix) of whole conversations: pieces of one task multiplied first, then FAN neighbours at a time."""
    schema = _typed(key, "at long, stats string, matrix string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "conv_id", "group"):
            stats = json.loads(run[0]["stats"])
            for more in run[1:]:
                stats = _joined_stats(stats, json.loads(more["stats"]))
            matrix = product([_matrix(r["matrix"]) for r in run])
            made = {"conv_id": run[0]["conv_id"], "at": run[0]["at"], "stats": json.dumps(stats), "matrix": json.dumps(matrix)}
            yield pa.RecordBatch.from_pylist([made], pa.schema([out_key, ("at", pa.int64()), ("stats", pa.string()), ("matrix", pa.string())]))

    from pyspark.sql.pandas.types import to_arrow_type

    out_key = pa.field("conv_id", to_arrow_type(key))
    found, span = pieces.select("conv_id", "at", "stats", "matrix"), 1
    while True:
        grouped = found.withColumn("group", F.floor(F.shiftright("at", 32) / F.lit(span)))
        found = grouped.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "at").mapInArrow(fold, schema)
        if span >= tasks:
            return found
        span *= FAN


def _slices(pieces: DataFrame, totals: DataFrame, key: T.DataType) -> DataFrame:
    """(conv_id, at, data, edits, place, system): what is to be done in each piece of the conversations that several tasks hold."""
    sizes = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", F.get_json_object("stats", "$.n_rows").cast("int").alias("n")))).alias("sizes"))
    sizes = sizes.withColumnRenamed("conv_id", "own_id")
    both = totals.join(sizes, F.col("conv_id").eqNullSafe(F.col("own_id"))).select("audit", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, system, out = 0, _system(row["audit"]), []
                for s, edits in zip(row["sizes"], parts(row["audit"], [s["n"] for s in row["sizes"]])):
                    out.append({"own_at": s["at"], "edits": edits, "place": place, "system": system})
                    place += len(edits) - edits.count(DELETE)
                yield pa.RecordBatch.from_pylist(out, pa.schema([("own_at", pa.int64()), ("edits", pa.string()), ("place", pa.int64()), ("system", pa.bool_())]))

    cut = both.mapInArrow(run, "own_at long, edits string, place long, system boolean")
    return pieces.select("conv_id", "at", "data").join(cut, F.col("at") == F.col("own_at")).drop("own_at")


def _data(packed: bytes) -> Iterator[tuple[str, str]]:
    table = X.unpack(packed)
    return zip(table["role"].to_pylist(), table["text"].to_pylist())


def _total(df: DataFrame, key: T.DataType) -> DataFrame:
    """The report of each whole conversation (conv_id, stats, matrix, sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for row in batch.select(["stats", "matrix", "sha256"]).to_pylist():
                out.append(_report(json.loads(row["stats"]), *cheapest(_matrix(row["matrix"]))) | {"repaired_sha256": row["sha256"]})
            rest = pa.RecordBatch.from_pylist(out, pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in fields]))
            yield pa.RecordBatch.from_arrays([ids, *rest.columns], ["conv_id", *rest.schema.names])

    fields = T._parse_datatype_string(REPORT).fields
    return df.select("conv_id", "stats", "matrix", "sha256").mapInArrow(run, _typed(key, REPORT))


def _digests(slices: DataFrame, key: T.DataType) -> DataFrame:
    """(own_id, own_sha256) of each conversation, its pieces streamed in order."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                made = [f"{role}:{text}" for _, role, text in repaired(row["edits"], _data(row["data"]), row["place"], row["system"])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([row["at"]], pa.int64()), pa.array(["\n".join(made) if made else None], pa.string())], ["conv_id", "at", "lines"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, state, some = None, None, False
        for batch in batches:
            for i, (conv, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist())):
                if state is None or conv != ids[0].as_py():
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([ids, pa.array([state.hexdigest()])], ["own_id", "own_sha256"])
                    ids, state, some = batch.column("conv_id").slice(i, 1), hashlib.sha256(), False
                if text is not None:
                    state.update((("\n" if some else "") + text).encode())
                    some = True
        if state is not None:
            yield pa.RecordBatch.from_arrays([ids, pa.array([state.hexdigest()])], ["own_id", "own_sha256"])

    made = slices.select("conv_id", "at", "data", "edits", "place", "system").mapInArrow(lines, _typed(key, "at long, lines string"))
    schema = T.StructType([T.StructField("own_id", key), T.StructField("own_sha256", T.StringType())])
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(hashed, schema)


def _found(rows: DataFrame, digest: bool) -> tuple[T.DataType, DataFrame, DataFrame, DataFrame]:
    """(type of conv_id, whole conversations, pieces of the others, reports of those)."""
    X.tune(rows.sparkSession)
    key = rows.schema["conv_id"].dataType
    scanned_ = X.checkpoint(_scan(rows, key, digest))
    tasks = scanned_.rdd.getNumPartitions()
    whole, pieces = scanned_.where("whole"), scanned_.where("not whole")
    return key, whole, pieces, X.checkpoint(_total(_levels(pieces, key, tasks).withColumn("sha256", F.lit(None).cast("string")), key))


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): faults found, cost and edits of the cheapest repair, digest of what it leaves.

    Edits are Keep, Rerole to user or assistant, Delete (the one choice for a blank or duplicate turn) and Insert of an
    empty turn; of repairs at equal cost the one with the least edits is taken.  The digest is the SHA-256 of the repaired
    `role:text`, joined by newlines.  Ids in conversations (conv_id) that have no rows get a report of nothing.
    """
    key, whole, pieces, totals = _found(rows, True)
    digests = _digests(_slices(pieces, totals, key), key)
    long = totals.drop("repaired_sha256").join(digests, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id").withColumnRenamed("own_sha256", "repaired_sha256")
    found = _total(whole, key).unionByName(long)
    if conversations is None:
        return found
    ids = conversations.select(F.col("conv_id").alias("own_id")).distinct()
    names = [f.name for f in T._parse_datatype_string(REPORT).fields]
    nothing = {c: F.lit(hashlib.sha256(b"").hexdigest()) if c == "repaired_sha256" else F.lit("") if c == "audit" else F.lit(0).cast("long") for c in names}
    joined = ids.join(found, F.col("own_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("own_id").alias("conv_id"), *(F.coalesce(c, nothing[c]).alias(c) for c in names))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), place from 0 in each."""
    key, whole, pieces, totals = _found(rows, False)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                edits = row["edits"] if "edits" in row else cheapest(_matrix(row["matrix"]))[1]
                place, system = (row["place"], row["system"]) if "edits" in row else (0, _system(edits))
                made = list(repaired(edits, _data(row["data"]), place, system))
                if made:
                    edit, role, text = (pa.array(list(x), pa.string()) for x in zip(*made))
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(made))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(place, place + len(made)), pa.int64()), role, text, edit], ["conv_id", "place", "role", "text", "edit"])

    schema = _typed(key, "place long, role string, text string, edit string")
    long = _slices(pieces, totals, key).select("conv_id", "data", "edits", "place", "system").mapInArrow(one, schema)
    return whole.select("conv_id", "matrix", "data").mapInArrow(one, schema).unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults planted by the hash of `conv_id:turn`, as the registered query's contract says; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    left = rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return left.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select("conv_id", "turn", "role", "text")
