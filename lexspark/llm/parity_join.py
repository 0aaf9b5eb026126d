"""Operator 9: n-gram Jaccard join by parity sketches.

The hash of each shingle flips one bit of a document's sketch, so the Hamming distance of two sketches never exceeds
the size of the symmetric difference of their sets. Two sets of sizes a and b with a similarity of t percent differ in
at most (a + b)(100 - t) / (100 + t) shingles. A band holds the sizes from a power of two up to the next one. Its sketches
have half as many blocks again as sets of the band may differ in, each of 65,536 bits. A document has a sketch for its own
band and for each higher one that a set linked with it can lie in.

Each differing shingle changes at most one block. If a document may differ from linked ones of the band in D shingles and has
bits in u > D blocks, at least u - D of these agree with those of a linked set. So of its blocks, in an order that all
documents share, the first D + 1 are enough: the first block in which both agree is among them. The order puts blocks with more
bits first, as they agree by chance least. A document with bits in at most D blocks gives them all, empty ones too.
Documents are joined on (band, block, bits), candidates are first filtered by the Hamming distance of one small sketch
each, then verified on their exact sets.

Documents with equal sets form one class and are joined once. A group that shares a block isn't expanded into pairs:
its members are first verified against the member that shares most blocks with others. A group that then lies in one
component needs no more. Of the others, small ones are expanded into pairs across components, and large ones compared in
chunks, so that no link that connects components is lost. Groups meet with their sketches alone: texts that merely share a
passage connect most large groups with each other, and exact sets are made only of what the sketches leave.

Defined cases: null or empty texts, and texts without words, have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle; repeated rows and copies get the same component; the component of documents is its
smallest doc_id, and a null doc_id never is that unless all are null; an empty table gives an empty table; only the two
named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.components import components
from lexspark.llm.shared import discard, record_batch, slices, split_by_keys, stored, texts_of
from lexspark.llm.shingles import mix, shingle_sets

BLOCK_BITS = 16
#: Open groups of at most FEW members are expanded into pairs, larger ones compared in chunks of about CHUNK members.
FEW, CHUNK = 8, 256
#: Sketches that are compared group by group in one call, about.
BATCH = 4096
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_SET = pa.schema([("cid", pa.int64()), ("members", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def most_different(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def block_keys(members: np.ndarray, band: int, percent: int) -> np.ndarray:
    """64-bit keys of the blocks by which the set meets those of the band that it can link with."""
    n, top = len(members), (2 << band) - 1
    differ = most_different(n, min(top, 100 * n // percent), percent)
    blocks = 3 * (most_different(top, top, percent) + 1) // 2
    block = ((members >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    place, times = np.unique((block << np.uint64(BLOCK_BITS)) | (members & np.uint64((1 << BLOCK_BITS) - 1)), return_counts=True)
    place = place[(times & 1).astype(bool)]  # the bits that are set
    used, first, bits = np.unique(place >> np.uint64(BLOCK_BITS), return_index=True, return_counts=True)
    with np.errstate(over="ignore"):
        salt = np.uint64(band) * np.uint64(0x9E3779B97F4A7C15)
        key = mix(mix(used + salt) + np.add.reduceat(mix(place), first)) if len(used) else used
        if len(used) > differ:
            return key[np.lexsort((key, -bits))[: differ + 1]].view(np.int64)
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), used)
        return np.concatenate([key, mix(mix(empty + salt))]).view(np.int64)


def size_sketch(members: np.ndarray) -> np.ndarray:
    """A parity sketch as 64-bit numbers; as many bits as the power of two from 0.6 times the set's size on, 128 at least.

    A wider sketch folds to a narrower one: numbers whose places are equal modulo the narrower width are XORed."""
    width = max(128, 1 << (6 * len(members) // 10).bit_length())
    place = ((members >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).view(np.int64)


def class_id(members: np.ndarray) -> int:
    """Equal for equal sets: the sum of scrambled members, scrambled again."""
    with np.errstate(over="ignore"):
        total = mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
        return int(mix(total + np.uint64(len(members))).view(np.int64)[0])


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, th (text hash), n_shingles, cid (class of equal sets), keys and sketch; the latter two only for the
    first document of a class in each task, so that a large group of copies gives few of them."""

    def sign(batches):
        seen: set[int] = set()
        for b in slices(batches):
            out: dict[str, list] = {f.name: [] for f in _SIGNATURE}
            for members in shingle_sets(texts_of(b), words):
                cid = keys = sketch = None
                if n := len(members):
                    cid = class_id(members)
                    if cid not in seen:
                        seen.add(cid)
                        bands = range(n.bit_length() - 1, (100 * n // percent).bit_length())
                        keys = np.concatenate([block_keys(members, band, percent) for band in bands])
                        sketch = size_sketch(members)
                out["n_shingles"].append(n)
                out["cid"].append(cid)
                out["keys"].append(keys)
                out["sketch"].append(sketch)
            yield record_batch(out | {"doc_id": b.column("doc_id"), "th": b.column("th")}, _SIGNATURE)

    return docs.mapInArrow(sign, "doc_id long, th long, n_shingles long, cid long, keys array<long>, sketch array<long>")


def exact_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, members) of the classes in ``wanted`` (columns doc_id, th, cid), computed again from one text each."""

    def members_of(batches):
        for b in slices(batches):
            yield record_batch({"cid": b.column("cid"), "members": [m.tobytes() for m in shingle_sets(texts_of(b), words)]}, _SET)

    perhaps, _ = split_by_keys(docs, ["doc_id", "th"], wanted.select("w_doc_id", "w_th"))
    one = perhaps.join(wanted, [perhaps.doc_id.eqNullSafe(wanted.w_doc_id), perhaps.th == wanted.w_th]).select("cid", "text")
    return one.mapInArrow(members_of, "cid long, members binary")


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, members) of the classes in ``pairs`` (a, b), one row each."""
    named = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(named, "cid", "left_semi").select("cid", F.col("doc_id").alias("w_doc_id"), F.col("th").alias("w_th")), "wanted-sets")
    return stored(exact_sets(docs, wanted, words).dropDuplicates(["cid"]), "sets")


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that by their sizes and sketches may have the wanted similarity."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both_widths = "least(size(s_a), size(s_b))"
    folded = lambda x: F.expr(f"if(size({x}) = {both_widths}, {x}, transform(sequence(0, {both_widths} - 1), i -> aggregate(sequence(i, size({x}) - 1, {both_widths}), 0L, (acc, j) -> acc ^ {x}[j])))")
    apart = F.aggregate(F.zip_with(folded("s_a"), folded("s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .where(apart <= F.expr(f"(n_a + n_b) * {100 - percent} div {100 + percent}")).select("a", "b"))


def linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the wanted similarity."""

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("m_a").to_pylist(), b.column("m_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=_PAIR)

    of = lambda x: sets.select(F.col("cid").alias(x), F.col("members").alias(f"m_{x}"))
    return near.join(of("a"), "a").join(of("b"), "b").mapInArrow(verify, "a long, b long")


def close_rows(n: np.ndarray, sketches, percent: int):
    """(i, those of the rows after i that by sizes and sketches may be linked with it); rows are ordered by their sizes ``n``."""
    wide = [np.asarray(x, np.int64).view(np.uint64) for x in sketches]  # widths of sketches grow with n
    width = 0
    for i in range(len(n) - 1):
        if len(wide[i]) != width:  # from here on all are at least as wide
            width, base = len(wide[i]), i
            sketch = np.array([np.bitwise_xor.reduce(x.reshape(-1, width)) for x in wide[i:]])
        rest = slice(i + 1, int(np.searchsorted(n, 100 * n[i] // percent, "right")))
        total = n[i] + n[rest]
        apart = np.bitwise_count(sketch[i - base] ^ sketch[rest.start - base : rest.stop - base]).sum(axis=1)
        passed = (apart <= total * (100 - percent) // (100 + percent)) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
        yield i, np.flatnonzero(passed) + i + 1


class Forest:
    """Trees over labels that grow together."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x


def alike_in_groups(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect what may be linked across components within large groups (columns key, cid, members, root).

    The members of a group are dealt into chunks of about ``CHUNK``; two chunks meet with their sketches alone, and of the
    pairs that pass only a spanning forest is returned. Many such meetings share a batch.
    """
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = (groups.select("key", "cid", "root", chunks.alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}))
    n_sketches = groups.select(F.sum(chunks)).first()[0] or 0
    batch = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, n_sketches // BATCH)))
    meeting = dealt.withColumn("batch", batch).join(classes.select("cid", "n_shingles", "sketch"), "cid")

    def forests(rows):
        found = []
        rows = rows.sort_values(["key", "low", "high", "n_shingles"])
        key, low, high, n, root, chunk, cid, sketch = (rows[c].to_numpy() for c in ("key", "low", "high", "n_shingles", "root", "chunk", "cid", "sketch"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        for at, end in zip(starts, [*starts[1:], len(key)]):
            trees, across = Forest(), low[at] != high[at]  # pairs within a chunk have a meeting of their own
            for i, close in close_rows(n[at:end], sketch[at:end], percent):
                close = close + at
                close = close[(root[close] != root[at + i]) & ((chunk[close] != chunk[at + i]) | (not across))]
                for j in close.tolist():
                    x, y = trees.top(int(cid[at + i])), trees.top(int(cid[j]))
                    if x != y:
                        trees.above[x] = y
                        found.append((cid[at + i], cid[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return meeting.groupBy("batch").applyInPandas(forests, "a long, b long")


def links_in_clusters(near: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within the clusters that the pairs ``near`` connect; ``roots`` (cid, root)
    has the components so far.

    In a cluster a pair is looked at once however many blocks it shares. The members are
    dealt into chunks of about ``CHUNK``; a task gets two chunks, compares their sketches in a block, verifies
    what passes on the exact sets and returns the links of a spanning forest.
    """
    cluster = components(near).select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    members = cluster.join(roots, "cid")
    chunks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = (members.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
             .join(classes.select("cid", "n_shingles", "sketch"), "cid").join(sets, "cid")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}))

    def forest(rows):
        rows = rows.sort_values("n_shingles")
        n = rows["n_shingles"].to_numpy()
        exact = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        chunk, cid = rows["chunk"].to_numpy(), rows["cid"].to_numpy()
        trees, found = Forest(), []
        roots = rows["root"].tolist()
        one_chunk = rows["low"].iloc[0] == rows["high"].iloc[0]
        for i, close in close_rows(n, rows["sketch"], percent):
            if not one_chunk:
                close = close[chunk[close] != chunk[i]]  # pairs within a chunk have a task of their own
            for j in close.tolist():
                x, y = trees.top(roots[i]), trees.top(roots[j])
                if x != y:
                    both = len(np.intersect1d(exact[i], exact[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        trees.above[x] = y
                        found.append((cid[i], cid[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("cluster", "low", "high").applyInPandas(forest, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), n_shingles, component_id."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    signed = stored(signatures(docs, words, percent), "signatures")
    keyed = signed.where("keys is not null")
    by_key = Window.partitionBy("key")
    shared = (keyed.select("cid", F.explode("keys").alias("key"))
              .withColumns({"least": F.min("cid").over(by_key), "most": F.max("cid").over(by_key), "size": F.count(F.lit(1)).over(by_key)})
              .where("least <> most").groupBy("key", "cid").agg(F.max("size").alias("size")))
    shared = stored(shared, "shared-blocks")
    # The member that meets most others leads its group.
    fame = shared.groupBy("cid").agg(F.sum("size").alias("fame"))
    groups = shared.join(fame, "cid")
    leaders = groups.groupBy("key").agg(F.max_by("cid", F.struct("fame", "cid")).alias("leader"), F.count(F.lit(1)).alias("members"))
    led = stored(groups.join(leaders, "key").select("key", "cid", "leader", "members"), "led-groups")
    classes = stored(keyed.join(fame.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min_by(F.struct("doc_id", "th", "n_shingles", "sketch"), F.struct("doc_id", "th")).alias("r")).select("cid", "r.*"), "classes")
    rows = stored(signed.select("doc_id", "th", "n_shingles", "cid"), "signed-rows")
    discard(signed, shared)

    # Exact sets are larger than texts: only those of classes that their sketches leave in a pair are made.
    near = stored(alike(led.where("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct(), classes, percent), "near-pairs")
    sets = sets_of(near, classes, docs, words)
    first = stored(linked(near, sets, percent), "links")
    roots = components(first).withColumnRenamed("node", "cid")
    rooted = stored(led.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted-groups")
    discard(led, sets)
    # Only groups that still hold several components need more pairs.
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    open_groups = stored(rooted.join(mixed, "key"), "open-groups")
    few, many = open_groups.where(F.col("members") <= FEW), open_groups.where(F.col("members") > FEW)
    side = lambda x: few.select("key", F.col("cid").alias(x), F.col("root").alias(f"root_{x}"))
    across = side("a").join(side("b"), "key").where("root_a <> root_b and a < b").select("a", "b").distinct()
    near_in_few = stored(alike(across, classes, percent), "near-pairs")
    near_in_many = stored(alike_in_groups(many, classes, percent).distinct(), "near-pairs")
    sets = sets_of(near_in_few.union(near_in_many), classes, docs, words)
    roots = rooted.select("cid", "root").distinct()
    links = stored(first.union(linked(near_in_few, sets, percent)).union(links_in_clusters(near_in_many, roots, classes, sets, percent)), "links")
    discard(rooted, open_groups, classes, sets)

    firsts = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"))
    named = components(links).withColumnRenamed("node", "cid").join(firsts, "cid")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = firsts.join(named.join(smallest, "root").select("cid", "component_id"), "cid", "left").select("cid", F.coalesce("component_id", "first").alias("component_id"))
    with_words = rows.where("cid is not null").join(found, "cid", "left").select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return with_words.union(rows.where("cid is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id and text) without the near-duplicates of others: of each component the row with the smallest
    doc_id stays (of equal ones that with the smallest text hash; of fully repeated texts one row). Rows without words stay."""
    found = near_duplicates(docs, words, percent).where("n_shingles > 0")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("k_doc_id"), F.col("k.th").alias("k_th"))
    times = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("times"))
    told = times.join(first, [times.doc_id.eqNullSafe(first.k_doc_id), times.th == first.k_th], "left").withColumn("stays", F.col("k_th").isNotNull())
    # Most rows stay and are alone: only those that go or stand repeatedly are written down and looked up, and of the texts only
    # repeated ones need to meet.
    marked = stored(told.where("not stays or times > 1").select(F.col("doc_id").alias("m_doc_id"), F.col("th").alias("m_th"), "stays"), "marked-rows")
    # The row as a whole lies in a struct, so that no added name can clash with its columns.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    empty = F.coalesce(F.regexp_replace("row.text", "[\\x20\\x09-\\x0D]", ""), F.lit("")) == ""
    perhaps, others = split_by_keys(rows, ["doc_id", "th"], marked.select("m_doc_id", "m_th"))
    same = [perhaps.doc_id.eqNullSafe(marked.m_doc_id), perhaps.th == marked.m_th]
    alone = perhaps.where(~empty).join(marked, same, "left_anti")
    repeated = perhaps.where(~empty).join(marked.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "th"])
    return alone.select("row.*").unionByName(repeated.select("row.*")).unionByName(others.select("row.*")).unionByName(perhaps.where(empty).select("row.*"))
