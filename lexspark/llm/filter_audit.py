"""Operator 11: how filters of a corpus interact, in every order of applying them.

Each document's failures are a bit mask, worked out once by built-in functions. Per part the documents are counted by mask:
at most 2^n cells of n filters, whatever the input. All orders follow from the cells: they are visited by swaps of adjacent
filters (plain changes), and a swap changes no other step than the two swapped ones, as what stands before or after both is
the same set. Each visit's removals are added to the Shapley counts on the way.

Whether a text stands in an earlier document is told by its first doc_id, joined on the text's SHA-256 and that doc_id
together, so that the copies of one text are spread over all tasks.

Defined cases: a null text is empty, a null part is ''; an empty text fails A and no other rule but E; a row without doc_id
has no place among the copies: it neither fails E nor makes another row fail; rows with the same doc_id and text count each
by itself and don't make each other fail; a document with several labels has the good or toxic one if one of them says so;
an empty table gives no rows; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def plain_changes(n: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """All orders of n things, each but the first with the place of the swap that made it from the one before (-1 for the first)."""
    order, moves = list(range(n)), [-1] * n
    yield tuple(order), -1
    while True:
        places = {x: k for k, x in enumerate(order)}
        able = [x for x in order if 0 <= places[x] + moves[x] < n and order[places[x] + moves[x]] < x]
        if not able:
            return
        x = max(able)
        low = min(places[x], places[x] + moves[x])
        order[low], order[low + 1] = order[low + 1], order[low]
        for y in range(x + 1, n):
            moves[y] = -moves[y]
        yield tuple(order), low


def audited(part: str, cells: list[tuple[int, int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """Rows of ``SCHEMA`` for one part from its cells (mask, documents, good ones, toxic ones)."""
    n = len(filters)
    total = sum(c[1] for c in cells)
    failing = [[c for c in cells if c[0] >> f & 1] for f in range(n)]
    fails = [sum(c[1] for c in own) for own in failing]
    alone = [sum(c[1] for c in own if c[0] == 1 << f) for f, own in enumerate(failing)]
    steps: list[tuple[int, int, int]] = [(0, 0, 0)] * n  # removed documents, good and toxic ones, by step of the present order
    shapley = [0] * n
    visited: list[tuple[tuple[int, ...], list[tuple[int, int, int]]]] = []
    for order, low in plain_changes(n):
        for k in range(n) if low < 0 else (low, low + 1):
            before = sum(1 << f for f in order[:k])
            gone = [c for c in failing[order[k]] if not c[0] & before]
            steps[k] = tuple(sum(c[j] for c in gone) for j in (1, 2, 3))
        for k, f in enumerate(order):
            shapley[f] += steps[k][0]
        visited.append((order, list(steps)))
    rows = []
    for order, own in visited:
        kept = total
        for k, f in enumerate(order):
            removed, good, toxic = own[k]
            kept -= removed
            rows.append((part, "".join(filters[x] for x in order), k + 1, kept, removed, fails[f] - removed, alone[f], good, toxic, shapley[f]))
    return rows


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = (F.size(w).cast("long") for w in (words, F.array_distinct(words)))
    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long")
    return [n < 100, 100 * distinct < 80 * n, 10 * capitals > F.length(text), text.rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit k set: filter k of ``FILTERS`` failed) of every row of ``docs`` (doc_id, text, lang)."""
    text = F.coalesce(docs.text, F.lit(""))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(text))), F.lit(0))
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), F.coalesce(docs.lang, F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"))
    first = docs.select(docs.doc_id.cast("long").alias("first"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("first_print")).groupBy("first_print").agg(F.min("first").alias("first"))
    joined = rows.join(first, (rows["print"] == first["first_print"]) & (rows["doc_id"] == first["first"]), "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` per part, order of the five filters and step; ``labels`` has doc_id, quality and toxic."""
    marked = labels.select(labels.doc_id.cast("long").alias("of"), (labels.quality == 1).alias("good"), (labels.toxic == 1).alias("toxic")).groupBy("of").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    masks = failure_masks(docs)
    rows = masks.join(marked, masks["doc_id"] == marked["of"], "left")
    counts = (F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))
    cells = rows.groupBy("part", "mask").agg(*counts)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 2^5 cells at most

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, own in zip(frame["part"], frame["cells"]):
                rows = audited(part, [(c["mask"], c["n"], c["n_good"], c["n_toxic"]) for c in own])
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return parts.mapInPandas(walk, SCHEMA)


#: The same by joins of cells with all orders.
SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
 w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) < doc_id as later from d),
 l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
 m as (select part, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(later, false)::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l using (doc_id)),
 cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
 f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
 orders as (select a.name || b.name || c.name || d.name || e.name as filter_order, unnest([{'step': 1, 'bit': a.bit, 'prior': 0}, {'step': 2, 'bit': b.bit, 'prior': a.bit}, {'step': 3, 'bit': c.bit, 'prior': a.bit + b.bit},
  {'step': 4, 'bit': d.bit, 'prior': a.bit + b.bit + c.bit}, {'step': 5, 'bit': e.bit, 'prior': a.bit + b.bit + c.bit + d.bit}]) as s
  from f a join f b on b.name <> a.name join f c on c.name not in (a.name, b.name) join f d on d.name not in (a.name, b.name, c.name) join f e on e.name not in (a.name, b.name, c.name, d.name)),
 x as (select part, filter_order, s.step as step, s.bit as bit, coalesce(sum(n) filter (mask & (s.bit + s.prior) = 0), 0) as kept, coalesce(sum(n) filter (mask & s.bit > 0 and mask & s.prior = 0), 0) as removed,
  coalesce(sum(n) filter (mask & s.bit > 0 and mask & s.prior > 0), 0) as redundant, coalesce(sum(n) filter (mask = s.bit), 0) as unique_fails,
  coalesce(sum(good) filter (mask & s.bit > 0 and mask & s.prior = 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & s.bit > 0 and mask & s.prior = 0), 0) as toxic_lost from cells, orders group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
 (sum(removed) over (partition by part, bit))::bigint as shapley from x
"""
