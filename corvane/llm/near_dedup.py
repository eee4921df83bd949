"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of bands are computed, and the key of table (i, j) joins band i of the
first with band j of the second: m * m tables from 2 * m bands. Only buckets that need it are so
divided: where band i alone brings together no more texts than a few blocks hold, they are one bucket,
and a text has m rows, not m * m. A text enters a table only if it shares the bands with some text.
Texts with equal shingle sets count as one.

Links are found in rounds whose work follows the number of bucket rows. First each text is
confirmed with one centre of its buckets; then with the most alike text of another component, as
told by a sketch (a byte of each minhash and two of each band's hash). What is left are buckets with
several components. Their pairs of different components go through the sketch in blocks of bounded size
(pairs within the largest component of a bucket are never formed), and texts with a likely partner
are compared on their full shingle sets in the same blocks, which give out only links that connect.
A pair that shares several buckets is handled in the first of them only; which that is, the sketch tells
with a chance of error below 1e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import shingles as S
from corvane.llm.shared import col, cut, stored

BANDS, ROWS = 20, 3
HASHES = 2 * BANDS * ROWS
#: Rounds with each text's most alike partner, and how alike the sketches then are at least.
PARTNER_ROUNDS, PARTNER_PERCENT = 1, 70
#: Rows of a partition of labels or links.
LABEL_ROWS = 200_000
#: Texts and shingles of one side of a block, rows and shingles of a task's table, pairs looked at together.
BLOCK_ROWS, BLOCK_SHINGLES, TABLE_ROWS, TABLE_SHINGLES, PAIRS = 1024, 1_000_000, 20_000, 2_000_000, 100_000
#: Texts up to which the bucket of one band is not divided by the second collection's bands.
WHOLE_ROWS = 4 * BLOCK_ROWS
#: Standard deviations that a linked pair's sketch may lie below its similarity.
DEVIATIONS = 4.6
_seeds = np.random.default_rng(77).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)


def _sets(batch: pa.RecordBatch, column: int, size: int):
    data, ends = S.raw_texts(batch.column(column))
    words, first, last = S.word_hashes(data, ends)
    return S.distinct(*S.shingle_hashes(words, first, last, size))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lows(values: np.ndarray, ends: np.ndarray, which: range) -> list[np.ndarray]:
    """These minhashes of all texts."""
    return [S.segment_reduce(np.minimum, (values ^ _seeds[1, k]) * (_seeds[0, k] | np.uint64(1)), ends) for k in which]


def _bands(lows: list[np.ndarray]) -> np.ndarray:
    """BANDS hashes of each text, each of ROWS minhashes."""
    out = []
    for i in range(BANDS):
        h = np.full(len(lows[0]), i, np.uint64)
        for low in lows[i * ROWS : (i + 1) * ROWS]:
            h = S.mix(h + low)
        out.append(h)
    return np.stack(out, 1)


def _lists(bands: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(_long(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))


def _node(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return _long(S.segment_reduce(np.add, S.mix(values + np.uint64(99)), ends))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """_id, text_hash, n_shingles, node (identity of the shingle set) and the first collection of bands."""

    def run(batches):
        for whole in batches:
            for batch in S.text_slices(whole, 1):
                values, ends = _sets(batch, 1, size)
                first = _lists(_bands(_lows(values, ends, range(HASHES // 2))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(ends)), _node(values, ends), first], names=["_id", "text_hash", "n_shingles", "node", "a"])

    return _source(docs, id_col, text_col).mapInArrow(run, "_id long, text_hash long, n_shingles long, node long, a array<long>")


def details(docs: DataFrame, size: int) -> DataFrame:
    """node, both collections of bands, sketch (a byte of each minhash, then two of each band's hash) and
    sorted distinct shingle hashes of (_id, _text) rows."""

    def run(batches):
        for whole in batches:
            for batch in S.text_slices(whole, 1):
                values, ends = _sets(batch, 1, size)
                lows = _lows(values, ends, range(HASHES))
                a, b = _bands(lows[: HASHES // 2]), _bands(lows[HASHES // 2 :])
                marks = np.concatenate([a, b], 1).astype(np.uint16).view(np.uint8)
                sketch = np.concatenate([np.stack([low.astype(np.uint8) for low in lows], 1), marks], 1)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _long(values))
                columns = [_node(values, ends), pa.array(np.diff(ends)), _lists(a), _lists(b), pa.array([x.tobytes() for x in sketch], pa.binary()), sets]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "a", "b", "sketch", "shingles"])

    return docs.mapInArrow(run, "node long, n long, a array<long>, b array<long>, sketch binary, shingles array<long>")


def _shared(nodes: DataFrame, band: str) -> DataFrame:
    """For each node the places of this collection's bands that another node has as well."""
    rows = nodes.select("node", F.posexplode(band).alias("i", "h")).select("node", "i", F.xxhash64("i", "h").alias("h"))
    again = rows.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("h")
    return rows.join(again, "h").groupBy("node").agg(F.collect_set("i").alias(f"at_{band}"))


def _members(rows: DataFrame) -> DataFrame:
    """key, its least cell, c (its nodes) and two marks of who they are, of buckets with at least two."""
    marks = [F.bit_xor(F.xxhash64("node")).alias("mix"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mix2")]
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("cell").alias("cell"), *marks).where("c > 1")


def buckets(nodes: DataFrame, at_a: DataFrame) -> DataFrame:
    """(key, cell, node, c): members of all buckets with at least two nodes, and how many those are.

    The cell of a whole bucket of band i is i * (BANDS + 1) + BANDS; if it is divided, + j instead, for band j
    of the second collection.
    """
    places = nodes.join(at_a, "node").select("node", "a", F.explode("at_a").alias("i"))
    rows = cut(places.select(F.xxhash64("i", F.get("a", F.col("i"))).alias("key"), (F.col("i") * (BANDS + 1) + BANDS).alias("cell"), "node"))
    full = cut(_members(rows))
    large = cut(full.where(F.col("c") > WHOLE_ROWS).select("key"))
    if not large.isEmpty():
        divided = rows.join(F.broadcast(large), "key").join(nodes.select("node", "b"), "node").select("key", "cell", "node", F.posexplode("b").alias("j", "h"))
        cells = cut(divided.select(F.xxhash64("key", "j", "h").alias("key"), (F.col("cell") - BANDS + F.col("j")).alias("cell"), "node"))
        rows = rows.join(F.broadcast(large), "key", "left_anti").unionByName(cells)
        full = full.where(F.col("c") <= WHOLE_ROWS).unionByName(_members(cells))
    # Tables often have the same bucket again: of buckets with the same members the first is enough.
    once = full.groupBy("c", "mix", "mix2").agg(F.min(F.struct("cell", "key")).alias("one")).select("one.key", "c")
    return cut(rows.join(once, "key"))


def _sized(df: DataFrame) -> DataFrame:
    """The rows of a checkpoint in as many partitions as they need: a few links are no work for hundreds of tasks."""
    return df.coalesce(max(1, -(-df.count() // LABEL_ROWS)))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the lowest node reachable over links, for every node that has a link.

    Each round takes the lowest label among a node and its neighbours, then the label's label.
    """
    links = _sized(links)
    both = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["x"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(lower.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (lx, ly) between them."""
    if links.isEmpty():
        return labels
    into = components(links, "lx", "ly").select(F.col("node").alias("label"), F.col("label").alias("into"))
    return _sized(cut(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label"))))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can meet the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _confirmed(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (lx, ly) between the labels of those pairs (x, y) whose full sets meet the similarity."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    common = F.size(F.array_intersect("sx", "sy"))
    joined = pairs.join(right, "y").join(left, "x")
    linked = joined.where(100 * common >= percent * (F.size("sx") + F.size("sy") - common)).select("x", "y")
    named = linked.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x").join(labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y")
    return cut(named.where("lx <> ly").select("lx", "ly").distinct())


def _centre_pairs(members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(x, y): each node and one centre of its buckets, the one with most others in its own."""
    degree = members.groupBy("node").agg(F.sum("c").alias("degree"))
    known = members.select("key", "node").join(degree.join(info, "node"), "node")
    known = cut(known)
    centre = known.groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("c"))
    near = known.join(centre, "key").where((F.col("node") != F.col("c.node")) & _alike(F.col("n"), F.col("c.n"), percent))
    return near.groupBy("node").agg(F.max(F.struct("c.degree", "c.node")).alias("c")).select(F.col("node").alias("x"), F.col("c.node").alias("y"))


ROWS_OF_BLOCKS = "key long, cell long, p long, q long, side long, node long, label long, n long"


def _blocks(members: DataFrame, labels: DataFrame, info: DataFrame) -> DataFrame:
    """ROWS_OF_BLOCKS of buckets with several labels.

    A small bucket is one block (p = q = 0). Of a larger one, the largest label's rows are the second
    side of blocks only; all other rows are paired with them and with each other.
    """
    rows = members.drop("c").join(labels, "node").join(info, "node")
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    whole = by_label.groupBy("key").agg(F.max(F.struct("c", "s", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("labels > 1")
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK_ROWS, s / BLOCK_SHINGLES))
    one = parts(F.col("c"), F.col("s")) <= 1
    major = F.when(one, F.lit(0)).otherwise(parts(F.col("top.c"), F.col("top.s")))
    minor = F.when(one, F.lit(1)).otherwise(F.greatest(F.lit(1), parts(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s"))))
    sizes = whole.select("key", F.col("top.label").alias("largest"), major.alias("major"), minor.alias("minor"))
    known = rows.join(sizes, "key")
    is_major = (F.col("major") > 0) & (F.col("label") == F.col("largest"))
    spread = F.xxhash64("node", F.lit(5))
    side = F.when(is_major, F.col("minor") + F.pmod(spread, F.greatest("major", F.lit(1)))).otherwise(F.pmod(spread, F.col("minor")))
    known = known.select("key", "cell", "node", "label", "n", "major", "minor", side.alias("side"))
    first = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("side"), F.col("minor") - 1)), lambda p: F.struct(p.alias("p"), F.col("side").alias("q")))
    after = F.filter(F.transform(F.sequence(F.col("side"), F.col("minor") + F.col("major")), lambda q: F.struct(F.col("side").alias("p"), q.alias("q"))), lambda x: (x["q"] > x["p"]) & (x["p"] < F.col("minor")) & (x["q"] < F.col("minor") + F.col("major")))
    placed = known.select("key", "cell", "node", "label", "n", "side", F.explode(F.concat(first, after)).alias("at"))
    return placed.select("key", F.col("cell").cast("long").alias("cell"), F.col("at.p").alias("p"), F.col("at.q").alias("q"), "side", "node", "label", "n")


def _least_matches(percent: int, deviations: float) -> int:
    """Bytes in which the sketches of a pair of this similarity agree at least."""
    p = percent / 100
    low = p - deviations * math.sqrt(p * (1 - p) / HASHES)
    return math.ceil(HASHES * (low + (1 - low) / 256))


def _ordered(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A table of whole blocks in their order: table, columns, sketches, and where each row's block ends."""
    at = {c: table.column(c).to_numpy() for c in ("key", "p", "q")}
    table = table.take(pa.array(np.lexsort([at["q"], at["p"], at["key"]])))
    x = {c: table.column(c).to_numpy() for c in ("key", "cell", "p", "q", "side", "node", "label", "n")}
    new = np.flatnonzero(np.r_[True, (np.diff(x["key"]) != 0) | (np.diff(x["p"]) != 0) | (np.diff(x["q"]) != 0)]) if table.num_rows else np.zeros(0, np.int64)
    stop = np.r_[new[1:], table.num_rows]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES + 4 * BANDS)
    return table, x, sketch, np.repeat(stop, stop - new)


def _likely(x: dict[str, np.ndarray], sketch: np.ndarray, stop: np.ndarray, percent: int, matches: int):
    """Chunks of (left, right, matches): pairs of a block that have their first bucket in common here and may be linked."""
    counts = stop - np.arange(len(stop)) - 1
    ends = np.concatenate([[0], np.cumsum(counts)])
    lows = np.ascontiguousarray(sketch[:, :HASHES])
    begin = 0
    while begin < len(stop):
        until = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PAIRS, "right")) - 1)
        own = counts[begin:until]
        left = np.repeat(np.arange(begin, until), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[begin:until] - ends[begin], own)
        begin = until
        n, m = x["n"][left], x["n"][right]
        across = (x["p"][left] == x["q"][left]) | (x["side"][left] != x["side"][right])
        ok = (x["label"][left] != x["label"][right]) & across & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        left, right = left[ok], right[ok]
        for k in range(0, len(left), PAIRS):
            a, b = left[k : k + PAIRS], right[k : k + PAIRS]
            total = np.count_nonzero(lows[a] == lows[b], axis=1)
            hit = total >= matches
            a, b, total = a[hit], b[hit], total[hit]
            same = sketch[a] == sketch[b]
            # Three bytes can agree by chance where a band's minhashes differ: its hash tells.
            bytes_of, marks = same[:, :HASHES].reshape(-1, 2, BANDS, ROWS).all(axis=3), same[:, HASHES:].reshape(-1, 2, BANDS, 2).all(axis=3)
            bands = (bytes_of & marks).argmax(axis=2)
            first, second = np.divmod(x["cell"][a], BANDS + 1)
            here = (bands[:, 0] == first) & ((second == BANDS) | (bands[:, 1] == second))
            yield a[here], b[here], total[here]


def _partners(table: pa.Table, percent: int) -> pa.Table:
    """x, y, matches: each row's most alike partner in its block."""
    _, x, sketch, stop = _ordered(table)
    best = np.full(len(stop), -1, np.int64)
    for a, b, total in _likely(x, sketch, stop, percent, _least_matches(PARTNER_PERCENT, 0)):
        np.maximum.at(best, a, total * (1 << 32) + b)
        np.maximum.at(best, b, total * (1 << 32) + a)
    at = np.flatnonzero(best >= 0)
    return pa.table({"x": x["node"][at], "y": x["node"][best[at] & 0xFFFFFFFF], "matches": best[at] >> 32})


def _with_partner(table: pa.Table, percent: int) -> pa.Table:
    """The rows that have a likely partner in their block."""
    table, x, sketch, stop = _ordered(table)
    has = np.zeros(len(stop), bool)
    for a, b, _ in _likely(x, sketch, stop, percent, _least_matches(percent, DEVIATIONS)):
        has[a] = has[b] = True
    return table.select([x.split()[0] for x in ROWS_OF_BLOCKS.split(", ")]).filter(pa.array(has))


def _links(table: pa.Table, percent: int) -> pa.Table:
    """(lx, ly): links between labels that connect something in this table, from the full sets."""
    table, x, sketch, stop = _ordered(table)
    lists = table.column("shingles").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)])
    _, codes = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    mark, into, out = np.zeros(int(codes.max(initial=0)) + 1, bool), {}, []
    labels = x["label"].tolist()

    def find(label):
        while (up := into.get(label, label)) != label:
            into[label] = label = into.get(up, up)
        return label

    for left, right, _ in _likely(x, sketch, stop, percent, _least_matches(percent, DEVIATIONS)):
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else left
        for i, j in zip(first.tolist(), np.r_[first[1:], len(left)].tolist(), strict=True):
            a = left[i]
            others = [b for b in right[i:j].tolist() if find(labels[a]) != find(labels[b])]
            if not others:
                continue
            mark[codes[ends[a] : ends[a + 1]]] = True
            for b in others:
                common = np.count_nonzero(mark[codes[ends[b] : ends[b + 1]]])
                if 100 * common >= percent * (x["n"][a] + x["n"][b] - common):
                    la, lb = find(labels[a]), find(labels[b])
                    if la != lb:
                        into[max(la, lb)] = min(la, lb)
                        out.append((labels[a], labels[b]))
            mark[codes[ends[a] : ends[a + 1]]] = False
    lx, ly = zip(*out, strict=True) if out else ([], [])
    return pa.table({"lx": pa.array(lx, pa.int64()), "ly": pa.array(ly, pa.int64())})


def _dealt(rows: DataFrame, most_rows: int, most_shingles: int | None = None) -> DataFrame:
    """rows with the number of a table; tables have whole blocks and about these sizes."""
    n, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tables = max(1, -(-n // most_rows), -(-shingles // most_shingles) if most_shingles else 1)
    return rows.withColumn("table", F.pmod(F.xxhash64("key", "p", "q"), F.lit(tables)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, max_broadcast_rows: int = 200_000, row_key: bool = False) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (lowest id reachable) and kept.

    Texts are linked whose sets of distinct word shingles have 100 * common >= percent * union;
    a text of fewer words is one shingle, and a null, empty or wordless one is linked with
    nothing. Equal texts, repeated rows included, are one component. A null id is never the
    lowest; a component of null ids only has a null component_id and is kept. Other columns are
    not read. Chance of missing a link at exactly 0.75: about 5e-5, far less above. With row_key there
    are also text_hash, which tells rows with one id or none apart, and component (null for wordless
    texts), since components of null ids or of repeated ids can have the same component_id.
    """
    signed = cut(signatures(docs, id_col, text_col, size))
    full = signed.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "text_hash")).alias("row")).withColumn("lowest", F.col("row._id"))
    at_a = cut(_shared(full, "a"))
    wanted = cut(nodes.join(at_a.select("node"), "node").select(F.col("row._id").alias("_one_id"), F.col("row.text_hash").alias("_one_hash")).distinct())
    one = F.broadcast(wanted) if wanted.count() <= max_broadcast_rows else wanted
    source = _source(docs, id_col, text_col)
    chosen = source.join(one, (F.col("text_hash") == F.col("_one_hash")) & F.col("_id").eqNullSafe(F.col("_one_id")), "left_semi").select("_id", "_text")
    known = stored(details(chosen, size))
    if known.count() > known.select("node").distinct().count():  # repeated rows
        known = stored(known.dropDuplicates(["node"]))
    members = buckets(known.select("node", "a", "b"), at_a)
    info, sets, sketches = known.select("node", "n"), known.select("node", "shingles"), known.select("node", "sketch")

    labels = _sized(cut(members.select("node").distinct().withColumn("label", F.col("node"))))
    labels = _merged(labels, _confirmed(cut(_centre_pairs(members, info, percent)), labels, sets, percent))
    for _ in range(PARTNER_ROUNDS):
        rows = _dealt(cut(_blocks(members, labels, info)), TABLE_ROWS).join(sketches, "node")
        found = rows.groupBy("table").applyInArrow(lambda t: _partners(t, percent), "x long, y long, matches long")
        pairs = cut(found.groupBy("x").agg(F.max(F.struct("matches", "y")).alias("best")).select(F.least("x", "best.y").alias("x"), F.greatest("x", "best.y").alias("y")).distinct())
        labels = _merged(labels, _confirmed(pairs, labels, sets, percent))
    rows = _dealt(cut(_blocks(members, labels, info)), TABLE_ROWS).join(sketches, "node")
    likely = cut(rows.groupBy("table").applyInArrow(lambda t: _with_partner(t, percent), ROWS_OF_BLOCKS))
    whole = _dealt(likely, TABLE_ROWS, TABLE_SHINGLES).join(known.select("node", "sketch", "shingles"), "node")
    linked = whole.groupBy("table").applyInArrow(lambda t: _links(t, percent), "lx long, ly long")
    labels = _merged(labels, cut(linked.distinct()))

    placed = nodes.select("node", "lowest").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = placed.groupBy("label").agg(F.min("lowest").alias("component_id"))
    by_node = cut(placed.join(lowest, "label").select("node", "component_id", F.col("label").alias("component")))
    some = full.select(F.col("_id").alias("doc_id"), "n_shingles", "node", "text_hash").join(by_node, "node").drop("node")
    none = signed.where("n_shingles = 0").select(F.col("_id").alias("doc_id"), "n_shingles", "text_hash", F.col("_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    return some.unionByName(none).select("doc_id", "n_shingles", "component_id", kept, *(["text_hash", "component"] if row_key else []))
