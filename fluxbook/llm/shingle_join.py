"""Operator 2: n-gram Jaccard join with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fluxbook.llm.components import connected_components
from fluxbook.llm.staging import WORD, keyed_rows, row_key, staged, text_hash
from fluxbook.llm.texts import LOWERED, U64, map_texts, mix, span_hashes, text_slices, windows, words_of

SHINGLE = 5
#: Similarity 75 / 100: an overlap of at least 3/7 of both sizes' sum, and 3/4 of the larger one.
#: A text lists its smallest tokens: a quarter, so that similar texts share one of them, and this
#: share more, so that they must share as many more.
EXTRA = 0.1
#: Members of a block that one signature tree holds.
CHUNK = 512
#: Tokens that so many texts of one task list are counted as frequent; the most frequent ones over all tasks are salted.
LOCALLY_FREQUENT, SALTED = 64, 50_000
#: Bits of the filter in front of the shuffle of token sets: 1 MB.
CLASS_BITS = 1 << 23


# --- token sets -----------------------------------------------------------------------------

def token_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each row; of fewer words their whole sequence; none without words."""
    starts, ends, rows = words_of(data, offsets)
    hashes = span_hashes(data, starts, ends, LOWERED)
    n = len(offsets) - 1
    tokens, at = windows(hashes, rows, SHINGLE)
    row = rows[at]
    words = np.bincount(rows, minlength=n)
    first = np.searchsorted(row, np.arange(n + 1))
    begin = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        if words[i] >= SHINGLE:
            out.append(np.unique(tokens[first[i]:first[i + 1]]))
        elif words[i]:
            whole, _ = windows(hashes[begin[i]:begin[i + 1]], np.zeros(words[i], np.int64), int(words[i]))
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_class(tokens: np.ndarray) -> int:
    """One number for equal sets, as the hash of the sum of the mixed tokens."""
    with np.errstate(over="ignore"):
        total = mix(tokens + U64(0x632BE59BD9B4E019)).sum(dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(len(tokens))
    return int(mix(np.array([total], U64)).view(np.int64)[0])


def listed(n: int) -> int:
    """How many of its smallest tokens a text lists."""
    return n - -(-3 * n // 4) + 1 + int(EXTRA * n)


def least_shared(n: Column) -> Column:
    """How many listed tokens a text shares with any similar one, which may be a quarter shorter."""
    return 1 + F.floor(EXTRA * F.ceil(0.75 * n) - 1e-9)


def _classes():
    def kernel(batch, first, end, data, offsets):
        sets = token_sets(data, offsets)
        return {"n": [len(s) for s in sets], "class": [set_class(s) if len(s) else None for s in sets]}

    return kernel


def _listing(salts: dict[int, int] | None):
    """Listed tokens of each class, once per task. Without ``salts`` only those that are frequent in the task, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        salted = np.array(sorted(salts), np.int64) if salts else np.zeros(0, np.int64)
        parts = np.array([salts[t] for t in salted.tolist()], np.int64) if salts else salted
        counted: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                tokens, classes, sizes = [], [], []
                for s in token_sets(data, offsets):
                    if not len(s):
                        continue
                    own = set_class(s)
                    if own in seen:
                        continue
                    seen.add(own)
                    few = s[:listed(len(s))].view(np.int64)
                    tokens.append(few), classes.append(np.full(len(few), own)), sizes.append(np.full(len(few), len(s), np.int32))
                if not tokens:
                    continue
                token = np.concatenate(tokens)
                if salts is None:
                    counted.append(token)
                    held += len(token)
                    continue
                owner = np.concatenate(classes)
                salt = np.zeros(len(token), np.int32)
                if len(salted):
                    near = np.minimum(np.searchsorted(salted, token), len(salted) - 1)
                    hit = salted[near] == token
                    salt[hit] = 1 + (owner[hit].view(U64) % parts[near[hit]].astype(U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(salt), pa.array(owner), pa.array(np.concatenate(sizes))], names=["token", "salt", "class", "n"]
                )
            if salts is None and held > 1 << 22:
                yield _frequent(counted)
                counted, held = [], 0
        if salts is None and counted:
            yield _frequent(counted)

    return run


def _frequent(counted: list[np.ndarray]) -> pa.RecordBatch:
    token, n = np.unique(np.concatenate(counted), return_counts=True)
    often = n >= LOCALLY_FREQUENT
    return pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(n[often].astype(np.int64))], names=["token", "n"])


# --- signature trees ------------------------------------------------------------------------

class SignatureTree:
    """A binary tree over token sets sorted by size.

    A node holds its members' OR-combined bitmaps, their size range, and the most tokens by
    which a member outnumbers the bits of its own bitmap. Two sets share at most as many tokens
    as their bitmaps share bits plus the smaller of their two excesses, and so do any two sets
    below two nodes.
    """

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, bits: int) -> None:
        sizes = np.array([len(sets[m]) for m in members])
        self.members = members[np.argsort(sizes, kind="stable")]
        n = len(self.members)
        marks = np.zeros((n, bits), bool)
        for i, m in enumerate(self.members):
            marks[i, (sets[m] >> U64(7)).astype(np.int64) & (bits - 1)] = True
        own_sizes = np.sort(sizes)
        packed = np.packbits(marks, axis=1).view(np.uint64)
        excess = own_sizes - marks.sum(1)
        self.low, self.high, self.left, self.right, self.bits, self.least, self.most, self.excess = [], [], [], [], [], [], [], []
        todo = [(0, n)]
        at = 0
        while at < len(todo):
            low, high = todo[at]
            at += 1
            self.low.append(low), self.high.append(high)
            self.bits.append(packed[low] if high - low == 1 else np.bitwise_or.reduce(packed[low:high]))
            self.least.append(int(own_sizes[low])), self.most.append(int(own_sizes[high - 1])), self.excess.append(int(excess[low:high].max()))
            if high - low == 1:
                self.left.append(-1), self.right.append(-1)
            else:
                middle = (low + high) // 2
                self.left.append(len(todo)), self.right.append(len(todo) + 1)
                todo += [(low, middle), (middle, high)]


def may_link(a: SignatureTree, i: int, b: SignatureTree, j: int) -> bool:
    """False if no set below node ``i`` of ``a`` can be similar to one below node ``j`` of ``b``."""
    if 4 * a.most[i] < 3 * b.least[j] or 4 * b.most[j] < 3 * a.least[i]:
        return False
    shared = int(np.bitwise_count(a.bits[i] & b.bits[j]).sum()) + min(a.excess[i], b.excess[j])
    return 7 * shared >= 3 * (a.least[i] + b.least[j])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, from sorted different tokens."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    near = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int((y[near] == x).sum())
    return 4 * shared >= 3 * (len(x) + len(y) - shared)


class Groups:
    """Which members of a block are linked so far."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def dual_links(sets: list[np.ndarray], asking: np.ndarray, all_members: np.ndarray, groups: Groups, leader: int) -> list[tuple[int, int]]:
    """Links that join the asking members to what they are similar to, by a dual traversal.

    Pairs already in one group are not compared, and a member that has come into the leader's
    group asks no more: others that are not in it ask for themselves.
    """
    bits = 1024
    while bits < 8 * max(len(sets[m]) for m in all_members) and bits < 1 << 18:
        bits *= 2
    a, b = SignatureTree(sets, asking, bits), SignatureTree(sets, all_members, bits)
    links, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        home = groups.top(leader)
        if all(groups.top(int(m)) == home for m in a.members[a.low[i]:a.high[i]]) or not may_link(a, i, b, j):
            continue
        if a.left[i] < 0 and b.left[j] < 0:
            x, y = int(a.members[a.low[i]]), int(b.members[b.low[j]])
            if groups.top(x) != groups.top(y) and similar(sets[x], sets[y]):
                groups.join(x, y)
                links.append((x, y))
        elif b.left[j] < 0 or (a.left[i] >= 0 and a.high[i] - a.low[i] >= b.high[j] - b.low[j]):
            todo += [(a.left[i], j), (a.right[i], j)]
        else:
            todo += [(i, b.left[j]), (i, b.right[j])]
    return links


def link_block(leader: int, classes: list[int], sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links within one part of a leader's block, and which members are outside the leader's group after it.

    All members are compared with the leader first; what is not similar to it asks the tree.
    """
    home = classes.index(leader)
    groups, links = Groups(len(classes)), []
    for i in range(len(classes)):
        if i != home and similar(sets[i], sets[home]):
            groups.join(i, home)
            links.append((i, home))
    outside = lambda: np.array([groups.top(i) != groups.top(home) for i in range(len(classes))])
    asking = np.flatnonzero(outside())
    if len(asking):
        links += dual_links(sets, asking, np.arange(len(classes)), groups, home)
    return [(classes[i], classes[j]) for i, j in links], outside()


BLOCK_ROWS = "leader long, part int, class long, other long, outside boolean, tokens binary"
_NAMES = ["leader", "part", "class", "other", "outside", "tokens"]


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every part of a block, rows sorted by leader and part; of blocks with several parts also their members."""

    def done(key, parts, rows):
        classes, sets = [], []
        for own, tokens in rows.items():
            classes.append(own), sets.append(np.frombuffer(tokens, U64))
        links, outside = link_block(key[0], classes, sets)
        out = [(key[0], key[1], a, b, False, None) for a, b in links]
        if parts > 1:
            out += [(key[0], key[1], c, None, bool(o), rows[c]) for c, o in zip(classes, outside) if c != key[0] or key[1] == 0]
        return out

    def written(out):
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_NAMES)

    key, parts, rows, out = None, 1, {}, []
    for batch in batches:
        for leader, part, n_parts, own, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != (leader, part):
                if key is not None:
                    out += done(key, parts, rows)
                key, parts, rows = (leader, part), n_parts, {}
                if len(out) > 2000:
                    yield written(out)
                    out = []
            rows[own] = tokens
    if key is not None:
        out += done(key, parts, rows)
    yield written(out)


def _link_parts(asking: pa.Table, members: pa.Table) -> pa.Table:
    """Links between members outside their leader's group in one part and all members of another part."""
    sets, classes, inside = [], [], []
    for table in (asking, members):
        for own, outside, tokens in zip(table["class"].to_pylist(), table["outside"].to_pylist(), table["tokens"].to_pylist()):
            classes.append(own), sets.append(np.frombuffer(tokens, U64)), inside.append(not outside)
    n = asking.num_rows
    leader = len(classes)
    groups = Groups(leader + 1)
    for i, known in enumerate(inside):
        if known:
            groups.join(i, leader)
    links = dual_links(sets, np.arange(n), np.arange(n, leader), groups, leader)
    return pa.table({"a": pa.array([classes[i] for i, _ in links], pa.int64()), "b": pa.array([classes[j] for _, j in links], pa.int64())})


# --- the join -------------------------------------------------------------------------------

def _blocks(chosen: DataFrame) -> DataFrame:
    """``class`` and ``leader``: every two similar classes have a leader in common.

    Classes that do not list enough shared tokens are similar to none and drop out first. As two
    similar classes share at least so many listed tokens, each may leave out all but one of that
    number, the most frequent ones by one order of all tokens: the rarest token they share stays
    with both. A token has a leader, the smallest class it is left with. The most frequent tokens
    are salted before the shuffle, so that no token fills a partition.
    """
    spark = chosen.sparkSession
    often = chosen.select("text").mapInArrow(_listing(None), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    salts = {r["token"]: 1 + r["n"] // LOCALLY_FREQUENT for r in often.orderBy(F.col("n").desc(), "token").limit(SALTED).collect()}
    tokens = chosen.select("text").mapInArrow(_listing(salts), "token long, salt int, class long, n int")
    alike = Window.partitionBy("token", "salt")
    shared = tokens.withColumns({"low": F.min("class").over(alike), "high": F.max("class").over(alike)}).filter("low < high or salt > 0")
    shared = staged(shared.select("token", "class", "n"), "join-shared").distinct()
    enough = shared.groupBy("class").agg(F.count("*").alias("shares"), F.first("n").alias("n")).filter(F.col("shares") >= least_shared(F.col("n"))).select("class")
    kept = staged(shared.join(enough, "class", "left_semi"), "join-tokens")
    often = kept.groupBy("token").agg(F.count("*").alias("lists")).filter("lists > 1")
    rarest_last = Window.partitionBy("class").orderBy(F.col("lists").desc(), "token")
    rare = kept.join(often, "token").withColumn("place", F.row_number().over(rarest_last)).filter(F.col("place") >= least_shared(F.col("n")))
    rare = staged(rare.select("token", "class"), "join-rare")
    leaders = rare.groupBy("token").agg(F.min("class").alias("leader"), F.count("*").alias("lists")).filter("lists > 1").select("token", "leader")
    return staged(rare.join(leaders, "token").select("leader", "class").distinct(), "join-blocks")


def _class_bits(classes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the classes' bits. Others may have the same bits: it only spares
    the shuffle token sets, most of them while the classes are few beside it."""
    place = F.pmod("class", F.lit(CLASS_BITS))
    rows = classes.groupBy(F.floor(place / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")).collect()
    out = np.zeros((CLASS_BITS // 32768, 4096), np.uint8)
    for row in rows:
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _wanted_sets(bits):
    """Token sets of the classes in a bitmap, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = bits.value, set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                classes, tokens = [], []
                for s in token_sets(data, offsets):
                    if len(s):
                        own = set_class(s)
                        place = own % CLASS_BITS
                        if marks[place >> 3] >> (place & 7) & 1 and own not in seen:
                            seen.add(own)
                            classes.append(own), tokens.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(tokens, pa.binary())], names=["class", "tokens"])

    return run


def _links(chosen: DataFrame) -> DataFrame:
    """``a``, ``b``: links between classes that connect all that are similar."""
    blocks = _blocks(chosen)
    sizes = blocks.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    part = F.pmod("class", F.col("parts").cast("long")).cast("int")
    # the leader itself stands in every part; that is spread out after the token sets are there
    of_class = blocks.join(sizes, "leader").groupBy("class").agg(F.collect_list(F.struct("leader", part.alias("part"), "parts")).alias("blocks"))
    of_class = staged(of_class, "join-of-class")
    bits = chosen.sparkSession.sparkContext.broadcast(_class_bits(of_class.select("class")))
    sets = chosen.select("text").mapInArrow(_wanted_sets(bits), "class long, tokens binary").join(of_class, "class")
    spread = F.when(F.col("b.leader") == F.col("class"), F.sequence(F.lit(0), F.col("b.parts") - 1)).otherwise(F.array("b.part"))
    rows = (
        sets.select("class", F.explode("blocks").alias("b"), "tokens")
        .select("b.leader", F.explode(spread).alias("part"), "b.parts", "class", "tokens")
        .repartition("leader", "part").sortWithinPartitions("leader", "part")
    )
    found = staged(rows.mapInArrow(_link_blocks, BLOCK_ROWS), "join-links")
    links = found.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
    members = found.filter("other is null").select("leader", "part", "class", "outside", F.octet_length("tokens").alias("size"), "tokens")
    if members.isEmpty():
        return links
    parts = members.groupBy("leader", "part").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    open_parts = members.filter("outside").groupBy("leader", "part").agg(F.min("size").alias("ask_least"), F.max("size").alias("ask_most"))
    pairs = (
        open_parts.withColumnRenamed("part", "from").join(parts.withColumnRenamed("part", "to"), "leader")
        .filter("`from` <> `to` and 4 * ask_most >= 3 * least and 4 * most >= 3 * ask_least").select("leader", "from", "to")
    )
    pairs = staged(pairs, "join-parts")
    asking = members.filter("outside").withColumnRenamed("part", "from").join(pairs, ["leader", "from"]).groupBy("leader", "from", "to")
    asked = members.withColumnRenamed("part", "to").join(pairs, ["leader", "to"])
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns]).groupBy("leader", "from", "to")  # new attributes, as both sides come from one table
    return links.unionByName(staged(asking.cogroup(asked).applyInArrow(_link_parts, "a long, b long"), "join-part-links"))


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``key`` and ``hash`` (which tell its row from others), ``n``, ``class``, ``root``, ``component_id``.

    Documents of one class have the same shingles; those of one ``root`` are connected by links.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns(
        {"key": row_key("id"), "hash": text_hash("text")}
    )
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("class", T.LongType())])
    slim = staged(map_texts(chosen, "text", ["id", "key", "hash"], added, _classes), "join-classes")
    roots = connected_components(_links(chosen))
    per_class = slim.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    rooted = staged(per_class.join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "least"), "join-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("class").alias("_class"), "root", "component_id")
    joined = slim.join(named, F.col("class") == F.col("_class"), "left")
    return joined.select("id", "key", "hash", "n", "class", "root", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def join_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_shingles``, ``component_id`` and ``class`` of every document.

    Two texts link if the Jaccard similarity of their sets of five-word shingles (A-Z in small
    letters) is at least 0.75; the component is named by its smallest id. The join is exact:
    equal sets are one class; classes that share listed tokens meet in the block of a common
    leader, are compared with it, and what is not similar to it goes through signature trees.

    NULL, empty and wordless texts have no shingles and link with nothing; their component is
    themselves. A NULL id takes part and gets the name of its component, NULL if there is no
    other; repeated rows are of one class; an empty table gives no rows; other columns are left
    aside.
    """
    return shingle_groups(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class"
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each component: that with the smallest id, NULL last; wordless rows all stay.

    Of rows with the same id and text one stays, as they are of one component.
    """
    groups = shingle_groups(docs, id_col, text_col)
    first = groups.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "hash")).alias("k")).select(
        "k.key", "k.hash"
    )
    order = Window.partitionBy("key", "hash").orderBy("hash")
    worded = F.coalesce(F.regexp_like(text_col, F.lit(WORD)), F.lit(False))
    kept = keyed_rows(docs.filter(worded), id_col, text_col).join(first, ["key", "hash"]).withColumn("place", F.row_number().over(order))
    return kept.filter("place = 1").select("doc.*").unionByName(docs.filter(~worded))


def op2_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return join_near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).drop("class")
