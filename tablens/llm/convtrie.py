"""Operator 13, the trie of conversation prefixes in minimal-perfect-hash node tables.

Turns are sorted over all tasks, so a conversation may span several: a task's place in a conversation and its prefix digest go on
from the tasks before it (one row a task passes through the driver). A prefix digest is the XOR of 128-bit
hashes of (depth, turn); rows with one digest must agree in depth, parent digest and 128 other bits of their turn's SHA-256,
else the job stops. Distinct digests are the nodes; counts are partial sums before any shuffle.

Each node belongs to the conversation of smallest hashed id among its members, so a conversation owns one
run of nodes down its path (a chain, cut every ``SEGMENT`` levels), and a path meets about log(n) chains whatever the ids.
Chains are dealt to shards of bounded size. A shard gives its digests slots of a minimal perfect hash, scatters counts into flat arrays
by slot and adds them up through a parent-slot array from the deepest level on. What hangs off a chain comes to it as sums
per node, one round for each chain on the way up; every such sum is grouped before it moves, so a node with
a third of all branches below it sends and receives one row.

Nulls: a null role or text is empty, a null turn comes first, rows with a null conversation id are left out. Turns of equal number are ordered by
role, then text; repeated rows are turns of their own. A conversation without turns is a member of the root. The ids are read as longs, and
``c % 20`` has the sign of c. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .perfecthash import PerfectHash
from .shingles import mix

SHARD_NODES, SEGMENT = 16_384, 16_384
_CHUNK = 16_384     # letters of joined ids in a row
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ places and digests over sorted tasks
def _runs(c: np.ndarray) -> np.ndarray:
    """For each row the index of the first row with its value (equal values are adjacent)."""
    starts = np.concatenate([[True], c[1:] != c[:-1]])
    return np.nonzero(starts)[0][np.cumsum(starts) - 1]


def _ends_of_tasks(ordered: DataFrame) -> list:
    """pid, first and last conversation of each task, and how many of its rows they have (one row a task that has any)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        n_first = n_last = 0
        for pdf in batches:
            if not len(pdf):
                continue
            c = pdf["c"].to_numpy()
            first = int(c[0]) if first is None else first
            n_first += int((c == first).sum())
            n_last = int((c == c[-1]).sum()) + (n_last if c[-1] == last else 0)
            last = int(c[-1])
        if first is not None:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "first": [first], "n_first": [n_first], "last": [last], "n_last": [n_last]})

    return sorted(ordered.select("c").mapInPandas(run, "pid int, first long, n_first long, last long, n_last long").collect())


def _carries(tasks: list) -> dict:
    """pid -> (rows of its first conversation in tasks before it, the first conversation after it)."""
    out, last, n = {}, None, 0
    for k, t in enumerate(tasks):
        before = n if t["first"] == last else 0
        out[t["pid"]] = (before, tasks[k + 1]["first"] if k + 1 < len(tasks) else None)
        n = t["n_last"] + (before if t["first"] == t["last"] else 0)
        last = t["last"]
    return out


def _placed(batches: Iterator[pd.DataFrame], carries: dict) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of a sorted task with each row's place in its conversation (from 1)."""
    last, n = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        c = pdf["c"].to_numpy()
        if last is None:
            last, n = c[0], carries[TaskContext.get().partitionId()][0]
        at = np.arange(len(c)) - _runs(c) + 1
        at = at + np.where(c == last, n, 0)
        last, n = c[-1], at[-1]
        yield pdf, at


def numbered(ordered: DataFrame) -> DataFrame:
    """``ordered`` (sorted and stored, first by ``c``) with ``place`` in the conversation."""
    carries = _carries(_ends_of_tasks(ordered))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in _placed(batches, carries):
            yield pdf.assign(place=at)

    return ordered.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in ordered.dtypes) + ", place long")


def _salted(pdf: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit hashes of (depth, turn)."""
    with np.errstate(over="ignore"):
        d = mix(at.astype(np.uint64))
        return tuple(mix(pdf[k].to_numpy(np.int64).view(np.uint64) + np.uint64(s) * d) for k, s in (("l1", 1), ("l2", 3)))


def prefixes(ordered: DataFrame) -> DataFrame:
    """c, depth, digest (hi, lo), parent's digest (phi, plo), l3, l4, words and whether it is the conversation's last
    turn, from sorted turns (c, l1 .. l4, words)."""
    carries = _carries(_ends_of_tasks(ordered))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc, whole = None, [0, 0], True
        for pdf, at in _placed(batches, carries):
            c = pdf["c"].to_numpy()
            whole = whole and (last is None or last == c[-1]) and c[0] == c[-1]
            mine = c == c[-1]
            for k, h in enumerate(_salted(pdf, at)):
                acc[k] = (acc[k] if c[-1] == last else 0) ^ int(np.bitwise_xor.reduce(h[mine]))
            last = c[-1]
        if last is not None:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "last": [int(last)], "whole": [whole],
                                "hi": np.array([acc[0]], np.uint64).view(np.int64), "lo": np.array([acc[1]], np.uint64).view(np.int64)})

    before, carry, last = {}, (0, 0), None
    for t in sorted(ordered.mapInPandas(tails, "pid int, last long, whole boolean, hi long, lo long").collect()):
        before[t["pid"]] = (carry, last)
        on = t["whole"] and t["last"] == last
        carry = (t["hi"] ^ carry[0], t["lo"] ^ carry[1]) if on else (t["hi"], t["lo"])
        last = t["last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def scanned():
            acc, last = None, None
            for pdf, at in _placed(batches, carries):
                if acc is None:
                    acc, last = before[TaskContext.get().partitionId()]
                c = pdf["c"].to_numpy()
                start = _runs(c)
                out = {"c": c, "depth": at}
                for k, (name, h) in enumerate(zip(("hi", "lo"), _salted(pdf, at))):
                    run_xor = np.bitwise_xor.accumulate(h)
                    run_xor ^= np.where(start > 0, run_xor[start - 1], np.uint64(0))
                    run_xor ^= np.where(c == last, np.array([acc[k]], np.int64).view(np.uint64)[0], np.uint64(0)) if last is not None else np.uint64(0)
                    out[name], out["p" + name] = run_xor.view(np.int64), (run_xor ^ h).view(np.int64)
                acc, last = (int(out["hi"][-1]), int(out["lo"][-1])), c[-1]
                yield pd.DataFrame(out | {k: pdf[k].to_numpy() for k in ("l3", "l4", "words")})

        held = None
        for pdf in scanned():
            if held is not None:
                yield held.assign(ends=np.append(held["c"].to_numpy()[1:] != held["c"].to_numpy()[:-1], held["c"].iloc[-1] != pdf["c"].iloc[0]))
            held = pdf
        if held is not None:
            after = carries[TaskContext.get().partitionId()][1]
            c = held["c"].to_numpy()
            yield held.assign(ends=np.append(c[1:] != c[:-1], after is None or c[-1] != after))

    return ordered.mapInPandas(run, "c long, depth long, hi long, phi long, lo long, plo long, l3 long, l4 long, words long, ends boolean")


# ------------------------------------------------------------------ the rebuilt conversations
def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c, place, l1 .. l4 (64-bit hashes of the SHA-256 of role and text), words: one row a turn, in order."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"),
                                empty(text_col).alias("text")).where("c is not null")
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("sha", sha).withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())      # parts equal rows only: any order of them is the same
    rows = rows.orderBy("c", F.asc_nulls_first("turn"), "role", "text", "row")
    return numbered(durable(rows.select("c", *[F.xxhash64("sha", F.lit(k)).alias(f"l{k}") for k in (1, 2, 3, 4)], "words")))


def rebuilt(own: DataFrame) -> DataFrame:
    """The turns (c, part, place, ...) of every conversation c after its first h are its own, those before
    are the first h of conversation c - c % 20; h = crc32 of its decimal id % 4."""
    c = F.col("c")
    base, h = c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4
    rest = own.where((c == base) | (F.col("place") > h)).withColumn("part", F.lit(1))
    few = own.where((c == base) & (F.col("place") <= 3)).withColumnRenamed("c", "base")
    takes = own.where((F.col("place") == 1) & (c != base) & (h > 0)).select("c", base.alias("base"), h.alias("h"))
    first = takes.join(few, "base").where("place <= h").withColumn("part", F.lit(0))
    names = ["c", "part", "place", "l1", "l2", "l3", "l4", "words"]
    return first.select(*names).unionByName(rest.select(*names))


# ------------------------------------------------------------------ nodes, chains and sums
def node_table(paths: DataFrame) -> DataFrame:
    """One row a distinct prefix: hi, lo, phi, plo, depth, conv, owner, seg, n_convs, words, n_children."""
    both = lambda k: F.min(k) == F.max(k)
    sound = both("depth") & both("phi") & both("plo") & both("l3") & both("l4")
    nodes = paths.groupBy("hi", "lo").agg(
        F.min("depth").alias("depth"), F.min("phi").alias("phi"), F.min("plo").alias("plo"), F.min("c").alias("conv"),
        F.min(F.xxhash64("c")).alias("owner"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"), sound.alias("sound"))
    nodes = nodes.select("hi", "lo", "phi", "plo", "depth", "conv", "owner", F.floor(F.col("depth") / SEGMENT).alias("seg"), "words",
                         F.when(F.col("sound"), F.col("n")).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("n_convs"))
    nodes = durable(nodes)
    children = nodes.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    return durable(nodes.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _sums(df: DataFrame, *keys):
    return df.groupBy(*keys).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def hanging(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hi, lo, owner, seg, saved, leaves): what hangs off nodes in other chains, one row a node and round; and the nodes that
    other chains hang off."""
    value = nodes.select("owner", "seg", "depth", "phi", "plo", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                         (F.col("n_children") == 0).cast("bigint").alias("leaves"))
    heads = durable(value.groupBy("owner", "seg").agg(
        F.min("depth").alias("top"), F.min_by("phi", "depth").alias("phi"), F.min_by("plo", "depth").alias("plo"),
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).where("top > 1"))     # chains from the root hang off it alone
    at = durable(_sums(heads, F.col("phi").alias("hi"), F.col("plo").alias("lo")).join(
        nodes.select("hi", "lo", "owner", "seg", "conv"), ["hi", "lo"]))
    joints, out = at.select("hi", "lo", "owner", "seg", "conv"), None
    while not at.isEmpty():
        part = at.select("hi", "lo", "owner", "seg", "saved", "leaves")
        out = part if out is None else out.unionByName(part)
        up = _sums(at, "owner", "seg").join(heads.select("owner", "seg", F.col("phi").alias("hi"), F.col("plo").alias("lo")), ["owner", "seg"])
        at = durable(_sums(up, "hi", "lo").join(joints, ["hi", "lo"]))
    return (at.select("hi", "lo", "owner", "seg", "saved", "leaves") if out is None else out), joints


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: whole chains and what hangs off them (rows that are no nodes)."""
    is_node = pdf["is_node"].to_numpy(bool)
    node, extra = pdf[is_node], pdf[~is_node]
    long = lambda df, k: df[k].to_numpy(np.int64)
    table = PerfectHash(long(node, "hi"), long(node, "lo"))
    slot = table.find(long(node, "hi"), long(node, "lo"))

    def scatter(name: str) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        out[slot] = long(node, name)
        return out

    col = {k: scatter(k) for k in ("hi", "lo", "phi", "plo", "depth", "conv", "owner", "seg", "n_convs", "words", "n_children")}
    parent = table.find(col["phi"], col["plo"])
    parent[(col["owner"][parent] != col["owner"]) | (col["seg"][parent] != col["seg"])] = -1       # another chain adds itself by rounds
    saved, leaves = (col["n_convs"] - 1) * col["words"], (col["n_children"] == 0).astype(np.int64)
    if len(extra):
        to = table.find(long(extra, "hi"), long(extra, "lo"))
        np.add.at(saved, to, long(extra, "saved"))
        np.add.at(leaves, to, long(extra, "leaves"))
    order = np.argsort(-col["depth"], kind="stable")
    cuts = np.nonzero(np.diff(col["depth"][order]))[0] + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    known = parent >= 0
    return pd.DataFrame({k: col[k] for k in ("hi", "lo", "phi", "plo", "depth", "conv", "n_convs", "n_children")} | {
        "n_leaves": leaves, "saved_tokens": saved, "parent_conv": np.where(known, col["conv"][parent], 0), "known": known})


def ends_digests(ends: DataFrame) -> DataFrame:
    """hi, lo, sha: SHA-256 of the ids c that end at a node, ascending and comma-joined. Ids are joined to
    chunks where they are sorted, and the chunks of a node hashed in order, so no task holds a node's ids."""
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), _CHUNK // 21):       # a long has 20 letters at most
                part = pdf.iloc[i:i + _CHUNK // 21]
                text = part["c"].astype(str)
                yield text.groupby([part["hi"], part["lo"]], sort=False).agg(",".join).rename("ids").reset_index().assign(
                    first=part.groupby(["hi", "lo"], sort=False)["c"].first().to_numpy())

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            done = []
            for hi, lo, ids in zip(pdf["hi"], pdf["lo"], pdf["ids"]):
                if (hi, lo) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["hi", "lo", "sha"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["hi", "lo", "sha"])

    joined = ends.select("hi", "lo", "c").orderBy("hi", "lo", "c").mapInPandas(chunks, "hi long, lo long, ids string, first long")
    return joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInPandas(digests, "hi long, lo long, sha string")


def trie(own: DataFrame, parts: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """All nodes of the trie of the conversations in ``parts`` (c, part, place, l1 .. l4, words), with every
    conversation of ``own`` a member of the root."""
    ordered = durable(parts.orderBy("c", "part", "place").select("c", "l1", "l2", "l3", "l4", "words"))
    paths = durable(prefixes(ordered))
    nodes = node_table(paths)
    extra, joints = hanging(nodes)
    count = nodes.count()
    shard = F.pmod(F.xxhash64("owner", "seg"), F.lit(max(1, -(-count // shard_nodes)))).alias("shard")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    names = ["hi", "lo", "phi", "plo", "depth", "conv", "owner", "seg", "n_convs", "words", "n_children", "saved", "leaves"]
    rows = nodes.withColumns({"saved": zero, "leaves": zero}).select(shard, F.lit(True).alias("is_node"), *names).unionByName(
        extra.withColumns({k: zero for k in names if k not in extra.columns}).select(shard, F.lit(False).alias("is_node"), *names))
    shape = ("hi long, lo long, phi long, plo long, depth long, conv long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, parent_conv long, known boolean")
    summed = durable(rows.groupBy("shard").applyInPandas(add_up, shape))

    convs = own.where("place = 1").select("c")
    turnless = convs.join(paths.where("depth = 1").select("c"), "c", "left_anti")
    lead = convs.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    below = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"),
                      F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0)).alias("saved_tokens"))
    first = lead.first()
    if first is None:
        return summed.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                             "n_leaves", "saved_tokens", F.lit("").alias("ends_sha256")).where("false")
    total = below.first()
    root = own.sparkSession.range(1).select(
        zero.alias("hi"), zero.alias("lo"), F.lit(first["conv"]).cast("bigint").alias("conv"), zero.alias("depth"), none.alias("parent_conv"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in (("n_convs", first["n_convs"]), *total.asDict().items())])
    names = root.columns
    same = summed.where("known").select(*names)
    tops = summed.where("not known and depth = 1").withColumn("parent_conv", F.lit(first["conv"]).cast("bigint")).select(*names)
    hung = (summed.where("not known and depth > 1").drop("parent_conv")
            .join(joints.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv").alias("parent_conv")), ["phi", "plo"]).select(*names))
    ends = ends_digests(paths.where("ends").select("hi", "lo", "c").unionByName(turnless.select(zero.alias("hi"), zero.alias("lo"), "c")))
    out = root.unionByName(same).unionByName(tops).unionByName(hung).join(ends, ["hi", "lo"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Contract of query 13 over all of ``conversations``, each rebuilt on the first turns of another."""
    own = durable(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(own, rebuilt(own))


SQL_TRIE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda j: 0::UBIGINT),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM o GROUP BY c),
k AS (SELECT c, l, c - c % 20 AS b, (xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
    lambda a, x: xor(t[(xor(a, x) & 255::UBIGINT)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 4)::BIGINT AS h FROM g, tab),
r AS (SELECT k.c, CASE WHEN k.c = k.b THEN k.l ELSE coalesce(list_slice(g.l, 1, k.h), []) || list_slice(k.l, k.h + 1, len(k.l)) END AS l
  FROM k LEFT JOIN g ON g.c = k.b),
p AS (SELECT c, len(l) AS n, d, list_slice(l, 1, d) AS path FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ids,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY path, d),
e AS (SELECT list_slice(path, 1, d - 1) AS path, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN e ON e.path = n.path AND e.d = n.d),
u AS (SELECT list_slice(path, 1, k) AS path, k, sum(leaf) AS leaves, sum(saved) AS saved FROM (
  SELECT path, unnest(range(0, d + 1)) AS k, (kids = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.kids::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN u ON u.path = f.path AND u.k = f.d LEFT JOIN n m ON m.path = list_slice(f.path, 1, f.d - 1) AND m.d = f.d - 1"""
