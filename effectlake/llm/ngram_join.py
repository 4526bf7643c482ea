"""Set-similarity self-join of word shingles with token-combination prefixes.

Documents are sets of hashed 5-word shingles ("tokens"; 48 bits of hash).  Equal
sets are one class with one representative.  Two sets of sizes a and b link at
Jaccard 0.8 only if they share o = ceil(4 (a + b) / 9) tokens, so of any tokens
of the first at most a - o are missing from the second.

1. Prefixes.  In hash order, a prefix of a fifth of the set and some more must
   share tokens with every partner's prefix.  Tokens that at most ``RARE``
   prefixes hold are rare: each is a signature by itself, and pairs that share
   enough of them are candidates.  A pair without a common rare token shares
   only frequent ones in its prefixes, and so many that both documents are known
   by their number of frequent tokens.
2. Extended prefixes.  The prefixes of those documents grow to the whole set.
   Documents that share frequent tokens are first held against the most central
   document of each token, so that large groups of near copies become components
   at once.  Tokens held within one component can't join two others.  Of the rest,
   rare tokens are signatures again.
3. Combinations.  What is left are documents of next to nothing but frequent
   tokens, in different components.  Their frequent tokens are dealt into groups
   by hash, more groups than tokens that may differ, so that a linked pair has the
   same tokens in many groups: the combination of a group's tokens, about three of
   them, is a signature, and a prefix of the rarest signatures is joined.

Each candidate pair is verified on the whole sets.  Rows of a signature that a
single component holds are dropped before any join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, work_dir
from .components import components
from .textbytes import mix, slices, words

SHINGLE = 5
#: A token in more documents than this is frequent.
RARE = 24
#: More ids than this aren't broadcast: the same join then runs as a shuffle.
BROADCAST_IDS = 1_000_000
HOT_GROUPS = 4096
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SHORT = np.array([0, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct tokens of each document."""
    h, _, first = words(data, offsets)
    n = len(h)
    five = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        five[: n - 4] = sum(h[k : n - 4 + k] * _TURN[k] for k in range(SHINGLE))
        five = mix(five) & _LOW48
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            t = np.sort(five[a : b - 4])
            out.append(t[np.concatenate(([True], t[1:] != t[:-1]))])
        elif b > a:
            k = b - a
            out.append(mix((h[a:b] * _TURN[:k]).sum(dtype=np.uint64, keepdims=True) + _SHORT[k : k + 1]) & _LOW48)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(">u8").reshape(-1).astype(np.int64)


def prefix_length(n: int) -> int:
    return n if n <= 12 else min(n, n // 5 + 1 + max(4, n * 6 // 100))


def _prefix_length(n: Column) -> Column:
    return F.when(n <= 12, n).otherwise(F.floor(n / 5) + 1 + F.greatest(F.lit(4), F.floor(n * 6 / 100)))


def _needed(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * 4 / 9)


def _ids_only(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """rows semi- or anti-joined with ids (one column, id_); broadcast only where the ids are few enough."""
    few, (id_,) = ids.count() <= BROADCAST_IDS, fresh(rows, "id_")
    ids = ids.select(F.col("id_").alias(id_))
    return rows.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(id_), how)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, a, b (a digest of the set), head (the packed prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, head = [], [], [], []
            for _, data, offsets in slices(batch.column("text")):
                for t in shingle_sets(data, offsets):
                    n.append(len(t))
                    a.append(int(mix(t).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mix(t ^ _TURN[0]).sum(dtype=np.uint64).view(np.int64)))
                    head.append(pack(t[: prefix_length(len(t))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(head, pa.binary())], ["doc_id", "n", "a", "b", "head"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, a long, b long, head binary")


def _whole_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for _, data, offsets in slices(batch.column("text")) for t in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in rows], pa.int64()), pa.array([pack(t) for t in rows], pa.binary())], ["rep", "n", "tokens"])

    return docs.mapInArrow(run, "rep long, n long, tokens binary")


def _explode(rows: DataFrame, packed: str) -> DataFrame:
    """h, rep, n: one row per token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                tokens = [unpack(x) for x in part.column("p").to_pylist()]
                sizes = [len(t) for t in tokens]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens)), pa.array(np.repeat(part.column("rep").to_numpy(), sizes)), pa.array(np.repeat(part.column("n").to_numpy(), sizes))], ["h", "rep", "n"]
                    )

    return rows.select("rep", "n", F.col(packed).alias("p")).mapInArrow(run, "h long, rep long, n long")


def _hot_tokens(rows: DataFrame, packed: str) -> DataFrame:
    """h: tokens in at least 0.5 % (and 16) of the documents of some batch.  A token in that share of all documents is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = np.unique(unpack(b"".join(batch.column("p").to_pylist())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t[n >= max(16, batch.num_rows // 200)])], ["h"])

    return rows.select(F.col(packed).alias("p")).mapInArrow(run, "h long").distinct()


def _shared(rows: DataFrame, packed: str, scratch: str) -> DataFrame:
    """h, rep, n, c for tokens of at least two documents, c being their number.

    Hot tokens are counted with partial sums and get their count by broadcast; no
    task ever holds all rows of one of them."""
    post = _explode(rows, packed)
    hot = stored(_hot_tokens(rows, packed), f"{scratch}/hot")
    counted = post.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1")
    if 0 < hot.count() <= BROADCAST_IDS:
        ids = F.broadcast(hot.withColumnRenamed("h", "id_"))
        rest = post.join(ids, F.col("h") == F.col("id_"), "left_anti")
        counted = rest.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1")
        often = post.join(ids, F.col("h") == F.col("id_"), "left_semi")
        counts = stored(often.groupBy(F.col("h").alias("id_")).agg(F.count(F.lit(1)).alias("c")), f"{scratch}/hot_counts")
        counted = counted.unionByName(often.join(F.broadcast(counts), F.col("h") == F.col("id_")).where("c > 1").select("h", "rep", "n", "c"))
    return stored(counted, f"{scratch}/shared")


def _pairs(rows: DataFrame, more: list[str]) -> DataFrame:
    """Pairs x < y of different components that share tokens of ``rows`` (h, rep, n, comp, more...), and how many: k.  Each h is in at most RARE rows."""
    side = lambda s: rows.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "comp", *more)])
    both = side("x").join(side("y"), "h").where("rep_x < rep_y AND comp_x <> comp_y AND 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y)")
    keep = [f"{c}_{s}" for s in "xy" for c in ("n", *more)]
    return both.groupBy(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")).agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in keep])


def verify(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets have 100 |x & y| >= 80 |x | y|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True):
                a, b = unpack(p), unpack(q)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= 80 * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    one = whole.select(F.col("rep").alias("x"), F.col("tokens").alias("p"))
    two = whole.select(F.col("rep").alias("y"), F.col("tokens").alias("q"))
    return pairs.select("x", "y").distinct().join(one.hint("merge"), "x").join(two.hint("merge"), "y").select("x", "y", "p", "q").mapInArrow(run, "x long, y long")


def _hub_pairs(shared: DataFrame, scratch: str, hubs: int = 3) -> DataFrame:
    """Each document with the central documents that share most of its tokens: x < y.

    The centre of a token is the holder whose tokens are the commonest, by the
    mean of log c over its whole set, so that one very common passage doesn't make
    a centre.  A pair that differs too much to link costs one verification."""
    central = stored(shared.groupBy("rep", "n").agg(F.sum(F.log("c")).alias("s")).select("rep", (F.col("s") / F.col("n")).alias("s")), f"{scratch}/central")
    ranked = shared.join(central, "rep").groupBy("h").agg(F.max(F.struct("s", -F.col("rep"))).alias("m"))
    best = stored(ranked.select("h", (-F.col("m.col2")).alias("hub")), f"{scratch}/hubs")
    met = shared.join(best.hint("merge"), "h").where("rep <> hub").groupBy("rep", "n", "hub").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("rep").orderBy(F.col("k").desc(), "hub")
    met = met.where(F.col("k") >= F.col("n") * 0.3).withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs)
    return met.select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y"))


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")


def _across(rows: DataFrame, scratch: str) -> DataFrame:
    """Rows (h, comp, ...) of those h that more than one component holds."""
    several = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    return stored(rows.join(stored(several, f"{scratch}/several").hint("merge"), "h"), f"{scratch}/across")


def _signatures(tokens: np.ndarray, n: int) -> list[tuple[int, int, np.ndarray]]:
    """Lists of signatures of a document's frequent tokens: (list, needed, hashes).

    Sizes fall into classes of ratio 1.25, and partners differ by one class at
    most; each class deals tokens into more groups by hash than tokens by which
    a pair of its sizes may differ.  The combination of all tokens of a group is
    a signature.  A document serves its own class and the next.  At most ``apart``
    tokens are not common to the document and a partner, and each spoils one group
    at most, so that all but ``apart`` of a list's signatures are the partner's too:
    that is the number needed.  Where a list is too short for that, the tokens
    themselves follow as a list, of which a partner shares four fifths of n."""
    out = []
    first = int(np.floor(np.log(n) / np.log(1.25) + 1e-9))
    apart = (9 * len(tokens) - 8 * n + n * 5 // 4) // 9
    short = False
    for j in (first, first + 1):
        groups = int(np.ceil(0.3 * 1.25 ** (j + 1))) + 3
        order = np.argsort(tokens % groups, kind="stable")
        place = (tokens % groups)[order]
        edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        held = np.add.reduceat(mix(tokens[order].astype(np.uint64)), edge)
        out.append((j + 1, len(edge) - apart, mix(held + np.uint64(j) * _TURN[1] + place[edge].astype(np.uint64) * _TURN[2]).view(np.int64)))
        short |= len(edge) <= apart
    if short:
        out.append((-1, -(-4 * n // 5), tokens))
    return out


def _combinations(z: DataFrame, scratch: str) -> DataFrame:
    """z: h, rep, n, comp.  Candidate pairs x < y of different components from combinations of tokens.

    Of each list of signatures only a prefix is joined, the rarest first: a partner
    that shares as many as needed shares one of them.  Signatures that one
    component holds have no part in that, and shorten the prefix.  At the first
    signature that a pair shares, those before it and those of one component are
    spoiled, each by a token that isn't common to the pair: no more of them than the
    pair's sizes allow such tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.to_pylist():
                for k, needed, h in _signatures(np.sort(np.array(d["tokens"], np.int64)), d["n"]):
                    row = (d["rep"], d["n"], d["comp"], len(d["tokens"]), k, len(h), needed)
                    yield pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(np.full(len(h), v, np.int64)) for v in row]], ["h", "rep", "n", "comp", "t", "list", "size", "needed"])

    # Pairs without a common rare token share frequent ones only, four fifths of either's set at least.
    docs = z.groupBy("rep", "n", "comp").agg(F.collect_set("h").alias("tokens")).where(F.size("tokens") >= F.ceil(F.col("n") * 4 / 5))
    signed = stored(docs.mapInArrow(run, "h long, rep long, n long, comp long, t long, list long, size long, needed long"), f"{scratch}/signed")
    held = signed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("h", "c")
    across = signed.join(stored(held, f"{scratch}/held").hint("merge"), "h")
    own = Window.partitionBy("rep", "list")
    ranked = across.select("*", F.row_number().over(own.orderBy("c", "h")).alias("k"), F.count(F.lit(1)).over(own).alias("m"))
    prefix = ranked.where(F.col("k") <= F.col("m") - F.greatest(F.col("needed"), F.lit(1)) + 1)
    prefix = stored(prefix.select("h", "rep", "n", "comp", "t", (F.col("k") - 1 + F.col("size") - F.col("m")).alias("spoiled")), f"{scratch}/prefix")
    side = lambda s: prefix.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "comp", "t", "spoiled")])
    o = _needed(F.col("n_x"), F.col("n_y"))
    fits = F.expr("rep_x < rep_y AND comp_x <> comp_y AND 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y)") & (F.least("t_x", "t_y") >= o)
    fits = fits & (F.greatest("spoiled_x", "spoiled_y") <= F.col("t_x") + F.col("t_y") - 2 * o)
    x, y = side("x"), side("y").withColumnRenamed("h", "h_")
    return x.join(y, (F.col("h") == F.col("h_")) & fits).select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")).distinct()


def links(docs: DataFrame, reps: DataFrame, scratch: str) -> DataFrame:
    """Verified links x < y between representatives, enough to connect all that is linked.  reps: rep, n, head; docs: doc_id, text."""
    shared = _shared(reps, "head", f"{scratch}/one")
    often = stored(shared.where(F.col("c") > RARE).groupBy("rep", "n").agg(F.count(F.lit(1)).alias("f")), f"{scratch}/often")
    rare = shared.where(F.col("c") <= RARE).join(often.select("rep", "f"), "rep", "left").select("h", "rep", "n", F.coalesce("f", F.lit(0)).alias("f"), F.col("rep").alias("comp"))
    o = _needed(F.col("n_x"), F.col("n_y"))
    spare = lambda s: _prefix_length(F.col(f"n_{s}")) - F.col(f"f_{s}") - (F.col(f"n_{s}") - o)
    first = stored(_pairs(rare, ["f"]).where(F.col("k") >= F.greatest(F.lit(1), F.least(spare("x"), spare("y")))).select("x", "y"), f"{scratch}/first")
    least = F.least(F.ceil(F.col("n") * 0.64), 1 + F.greatest(F.lit(4), F.floor(F.col("n") * 0.048)))
    grown = stored(often.where(F.col("f") >= least).select("rep"), f"{scratch}/grown")
    ids = stored(grown.union(first.select("x")).union(first.select("y")).distinct().toDF("id_"), f"{scratch}/ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = stored(_whole_sets(_ids_only(texts, "doc_id", ids, "left_semi").select("doc_id", "text")), f"{scratch}/whole")
    long_ = _ids_only(whole, "rep", grown.toDF("id_"), "left_semi")
    shared = _shared(long_, "tokens", f"{scratch}/two")
    found = stored(verify(first.unionByName(_hub_pairs(shared, f"{scratch}/two")), whole), f"{scratch}/found")
    comps = components(found, f"{scratch}/comps")
    across = _across(_with_comp(shared, comps), f"{scratch}/two")
    often = stored(across.where(F.col("c") > RARE).groupBy("rep", "n", "comp").agg(F.count(F.lit(1)).alias("f")), f"{scratch}/often2")
    rare = across.where(F.col("c") <= RARE).join(often.select("rep", "f"), "rep", "left").select("h", "rep", "n", "comp", F.coalesce("f", F.lit(0)).alias("f"))
    second = _pairs(rare, ["f"]).where(F.col("k") >= F.greatest(F.lit(1), o - F.least("f_x", "f_y"))).select("x", "y")
    only = often.where(F.col("n") - F.col("f") <= F.floor(F.col("n") / 5)).select(F.col("rep").alias("id_"))
    z = across.where(F.col("c") > RARE).join(only, F.col("rep") == F.col("id_")).select("h", "rep", "n", "comp")
    z = stored(z, f"{scratch}/z")
    third = _combinations(_across(z, f"{scratch}/z2"), f"{scratch}/z3").select("x", "y")
    return found.unionByName(verify(stored(second.unionByName(third), f"{scratch}/second"), whole))


def similarity_join(docs: DataFrame, scratch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, rep (the smallest id with the same set).

    Texts without words have n_shingles 0 and link with nothing; rows with a null
    id have a component only through their set's class.  Rows that repeat an id
    and a text get a row each; rows that repeat an id with other texts are one
    document when it comes to links: what one links with, all do."""
    scratch = scratch or work_dir(docs.sparkSession)
    sets = stored(_sets(docs), f"{scratch}/sets")
    classes = stored(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times")), f"{scratch}/classes")
    limit = sets.count() // HOT_GROUPS + 1
    hot, cold = F.broadcast(classes.where(F.col("times") > limit)), classes.where(F.col("times") <= limit)
    plain = sets.where("n > 0").select("doc_id", "n", "a", "b")
    few = plain.join(hot, ["a", "b", "n"])
    rest = plain.join(hot.select("a", "b", "n"), ["a", "b", "n"], "left_anti").join(cold.hint("merge"), ["a", "b", "n"])
    members = stored(few.unionByName(rest).select("doc_id", "n", "rep"), f"{scratch}/members")
    others = members.where("doc_id <> rep").select(F.col("doc_id").alias("id_")).distinct()
    reps = _ids_only(sets.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "n", "head"), "rep", others, "left_anti")
    reps = reps.select("rep", "n", "head")
    joined = components(links(docs, reps, scratch), f"{scratch}/all")
    placed = members.join(joined, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"), "rep")
    none = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("rep"))
    return placed.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents, the row of the smallest id; documents that link with nothing stay.

    Rows of one id stay or go together, as do those without an id, which stay."""
    found = similarity_join(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("id_")).distinct()
    return _ids_only(docs, "doc_id", gone, "left_anti")


