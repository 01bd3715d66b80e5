"""Operator 11: cheapest repair of conversations by Hirschberg's divide and conquer.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles, so it is in one of four
states after each row. What a run of rows costs from each state to each other is a matrix of four
by four; matrices of neighbouring runs combine, and runs are solved apart once the states at their
ends are known.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxbook.llm.staging import row_key, running_totals, staged

SPACES = " \t\n\x0b\x0c\r"
MARKS = ".!?"
#: States: nothing yet, after a system row, after a user row, after an assistant row.
STATES = 4
#: Where a row of initial s, u, a leads from each state; None if it must not stand there.
LEADS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that may be inserted in a state, and the one that a row may be given there.
FITTING = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserts behind the last row that end a conversation in an allowed state.
CLOSING = ((), ("user", "assistant"), ("assistant",), ())
FAR = 1 << 48
#: Rows of a run, and runs that are combined at a time.
RUN, FAN = 1024, 1024


def _edit_tables() -> tuple[np.ndarray, np.ndarray, list[list[tuple[str, str | None]]]]:
    """Costs and orders of the cheapest edits of one row, inserts in front of it included, by kind of row, state before
    and after; and the edits, each with the role it gives.

    Kind 0 must be deleted; kind 1 + 2 i + t has initial i of s, u, a, other, and t is 1 if it is
    truncated. Orders rank the edit strings from one state; no such string begins another.
    """
    kinds = [None, *itertools.product(("s", "u", "a", ""), (0, TRUNCATED))]
    costs = np.full((len(kinds), STATES, STATES), FAR, np.int64)
    orders = np.zeros((len(kinds), STATES, STATES), np.int64)
    edits: list[list[tuple[str, str | None]]] = [[] for _ in range(costs.size)]
    for kind, before in itertools.product(range(len(kinds)), range(STATES)):
        best: dict[int, tuple] = {}
        state, inserted = before, []
        for _ in range(3):  # three inserts come back to where one led
            own = [(DELETE, "D", None, state)]
            if kinds[kind]:
                initial, marked = kinds[kind]
                if initial and LEADS[initial][state] is not None:
                    own.append((marked, "K", None, LEADS[initial][state]))
                own.append((REROLE + marked, "R", FITTING[state], LEADS[FITTING[state][0]][state]))
            for cost, letter, role, after in own:
                made = [("I", r) for r in inserted] + [(letter, role)]
                entry = (cost + INSERT * len(inserted), "".join(x for x, _ in made), made)
                if after not in best or entry[:2] < best[after][:2]:
                    best[after] = entry
            inserted.append(FITTING[state])
            state = LEADS[FITTING[state][0]][state]
        ranked = sorted(best, key=lambda q: best[q][1]) + [q for q in range(STATES) if q not in best]
        for q in range(STATES):
            orders[kind, before, q] = ranked.index(q)
        for q, (cost, _, made) in best.items():
            costs[kind, before, q] = cost
            edits[(kind * STATES + before) * STATES + q] = made
    return costs, orders, edits


COSTS, ORDERS, EDITS = _edit_tables()


def _further(cost: np.ndarray, order: np.ndarray, by_cost: np.ndarray, by_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors (..., state) one element on, whose matrices are (n, before, after).

    ``order`` ranks the least cheapest edits up to each state. As none of them begins another, what
    comes first there comes first with any edits behind it.
    """
    several = cost.ndim == 3
    if several:
        by_cost, by_order = by_cost[:, None], by_order[:, None]
    reach = (cost[..., :, None] + by_cost) * STATES + order[..., :, None]
    via = reach.argmin(-2)
    least = np.take_along_axis(reach, via[..., None, :], -2)[..., 0, :]
    own = np.take_along_axis(np.broadcast_to(by_order, reach.shape), via[..., None, :], -2)[..., 0, :]
    rank = np.take_along_axis(order, via, -1) * STATES + own
    return np.minimum(least // STATES, FAR), (rank[..., :, None] > rank[..., None, :]).sum(-1)


def combine(costs: np.ndarray, orders: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of runs of elements: least costs, and the order of the edits, from each state to each."""
    n = len(begins)
    cost = np.where(np.eye(STATES, dtype=bool), 0, FAR)[None].repeat(n, 0)
    order = np.tile(np.arange(STATES), (n, STATES, 1))
    long_first = np.argsort(begins - ends, kind="stable")
    sizes = (ends - begins)[long_first]
    for step in range(int(sizes.max(initial=0))):
        on = long_first[:np.searchsorted(-sizes, -step)]
        at = begins[on] + step
        cost[on], order[on] = _further(cost[on], order[on], costs[at], orders[at])
    return cost, order


def crossings(costs: np.ndarray, orders: np.ndarray, begins: np.ndarray, ends: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The state behind each element on the cheapest way through its run, of several the one whose edits come first.

    Forward costs from a run's beginning and backward costs from its end meet in its middle; the
    state with the least sum, of several the first in order, divides the run in two, until every
    run is one element. All runs are divided at once; besides the elements only the vectors are held.
    """
    after = np.zeros(len(costs), np.int64)
    keep = ends > begins
    begins, ends, enter, leave = begins[keep], ends[keep], enter[keep], leave[keep]
    while len(begins):
        single = ends - begins == 1
        after[begins[single]] = leave[single]
        begins, ends, enter, leave = begins[~single], ends[~single], enter[~single], leave[~single]
        if not len(begins):
            break
        sorted_by = np.argsort(begins - ends, kind="stable")
        begins, ends, enter, leave = begins[sorted_by], ends[sorted_by], enter[sorted_by], leave[sorted_by]
        n, middle = len(begins), (begins + ends) // 2
        cost = np.where(np.arange(STATES) == enter[:, None], 0, FAR)
        order = np.tile(np.arange(STATES), (n, 1))
        back = np.where(np.arange(STATES) == leave[:, None], 0, FAR)
        for step in range(int((ends - middle).max())):
            on = np.flatnonzero(begins + step < middle)
            cost[on], order[on] = _further(cost[on], order[on], costs[begins[on] + step], orders[begins[on] + step])
            on = np.flatnonzero(ends - 1 - step >= middle)
            back[on] = np.minimum((costs[ends[on] - 1 - step] + back[on][:, None, :]).min(-1), FAR)
        meet = ((cost + back) * STATES + order).argmin(1)
        begins, ends = np.concatenate([begins, middle]), np.concatenate([middle, ends])
        enter, leave = np.concatenate([enter, meet]), np.concatenate([meet, leave])
    return after


def _whole_runs(batches: Iterator[pa.RecordBatch], place: str, run: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs with the rows where these begin. A run begins where ``place`` is a multiple of its size."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        begins = np.flatnonzero(held[place].to_numpy() % run == 0)
        if len(begins) and begins[-1] > 0:
            yield held.slice(0, int(begins[-1])), begins[:-1]
            held = held.slice(int(begins[-1]))
    if held is not None and held.num_rows:
        yield held, np.flatnonzero(held[place].to_numpy() % run == 0)


def _matrices(run: int):
    """Per run its matrices, its first and last initial, and its pairs of initials that must not be neighbours."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _whole_runs(batches, "place", run):
            kind, initial = table["kind"].to_numpy(), table["initial"].to_numpy()
            ends = np.append(begins[1:], len(kind))
            cost, order = combine(COSTS[kind], ORDERS[kind], begins, ends)
            apart = _apart(initial[:-1], initial[1:])
            apart[begins[1:] - 1] = False
            upto = np.concatenate([[0], np.cumsum(apart), [apart.sum()]])
            lists = lambda m: pa.array(list(m.reshape(len(m), -1)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks().take(pa.array(begins)), pa.array(table["place"].to_numpy()[begins] // run), lists(cost), lists(order),
                 pa.array(initial[begins]), pa.array(initial[ends - 1]), pa.array(upto[ends - 1] - upto[begins])],
                names=["key", "run", "cost", "place_of", "first", "last", "illegal"],
            )

    return kernel


def _apart(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Initials (s, u, a, other as 0 to 3) that must not follow each other."""
    return ~(((first == 0) & (second == 1)) | ((first == 1) & (second == 2)) | ((first == 2) & (second == 1)))


def _square(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, STATES, STATES)


def _combined(runs: pa.Table) -> pa.Table:
    runs = runs.sort_by("run")
    cost, order = combine(_square(runs["cost"]), _square(runs["place_of"]), np.array([0]), np.array([runs.num_rows]))
    one = lambda m: pa.array([m.ravel()], pa.list_(pa.int64()))
    return pa.table({"key": runs["key"].slice(0, 1), "run": runs["above"].slice(0, 1), "cost": one(cost), "place_of": one(order)})


def _divided(runs: pa.Table) -> pa.Table:
    runs = runs.sort_by("run")
    enter, leave = (runs[c].slice(0, 1).to_numpy() for c in ("enter", "leave"))
    after = crossings(_square(runs["cost"]), _square(runs["place_of"]), np.array([0]), np.array([runs.num_rows]), enter, leave)
    return pa.table({"key": runs["key"], "run": runs["run"], "enter": pa.array(np.concatenate([enter, after[:-1]])), "leave": pa.array(after)})


def run_states(runs: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``key``, ``run``, ``enter``, ``leave`` of every run, and ``key``, ``cost``, ``leave`` of every conversation.

    Runs of a long conversation are combined ``fan`` at a time, these again, and so on; then the
    states go down the same tree. A conversation of one run takes no part in it.
    """
    slim = runs.select("key", "run", "cost", "place_of")
    many = slim.filter("run > 0").select("key").distinct()
    levels = [slim.join(many, "key", "left_semi")]
    most = slim.agg(F.max("run")).first()[0] or 0
    while most > 0:
        up = levels[-1].withColumn("above", F.floor(F.col("run") / fan).cast("long")).groupBy("key", "above")
        levels.append(staged(up.applyInArrow(_combined, "key string, run long, cost array<long>, place_of array<long>"), "chat-runs"))
        most //= fan
    top = slim.join(many, "key", "left_anti").unionByName(levels[-1])
    ends = F.array(*[
        F.struct((F.element_at("cost", q + 1) + INSERT * len(CLOSING[q])).alias("cost"), F.element_at("place_of", q + 1).alias("order"), F.lit(q).cast("long").alias("leave"))
        for q in range(STATES)
    ])
    solved = staged(top.select("key", "run", F.array_min(ends).alias("end")).select("key", "run", F.lit(0).cast("long").alias("enter"), "end.leave", "end.cost"), "chat-ends")
    states = solved.select("key", "run", "enter", "leave")
    if len(levels) == 1:
        return states, solved.select("key", "cost", "leave")
    whole = states.join(many, "key", "left_anti")
    known = states.join(many, "key", "left_semi")
    for level in reversed(levels[:-1]):
        below = level.withColumn("above", F.floor(F.col("run") / fan).cast("long")).join(known.withColumnRenamed("run", "above"), ["key", "above"])
        known = staged(below.groupBy("key", "above").applyInArrow(_divided, "key string, run long, enter long, leave long"), "chat-states")
    return whole.unionByName(known), solved.select("key", "cost", "leave")


def _rows_with_edits(run: int):
    """Each row's edits in order: inserts, then its own."""
    longest = max(map(len, EDITS))
    letters = np.array([[x for x, _ in e] + [""] * (longest - len(e)) for e in EDITS])
    roles = np.array([[r or "" for _, r in e] + [""] * (longest - len(e)) for e in EDITS])
    sizes = np.array([len(e) for e in EDITS])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _whole_runs(batches, "place", run):
            kind = table["kind"].to_numpy().astype(np.int64)
            enter, leave = table["enter"].to_numpy(), table["leave"].to_numpy()
            after = crossings(COSTS[kind], ORDERS[kind], begins, np.append(begins[1:], len(kind)), enter[begins], leave[begins])
            before = np.empty_like(after)
            before[1:] = after[:-1]
            before[begins] = enter[begins]
            which = (kind * STATES + before) * STATES + after
            row = np.repeat(np.arange(len(which)), sizes[which])
            step = np.arange(len(row)) - (np.cumsum(sizes[which]) - sizes[which])[row]
            edit, role = letters[which[row], step], roles[which[row], step]
            own = pa.array(np.where(edit == "I", -1, row), mask=edit == "I")
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks().take(pa.array(row)), pa.array(table["place"].to_numpy()[row]), pa.array(step.astype(np.int32)),
                 pa.array(edit.tolist(), pa.string()), pa.array([r or None for r in role.tolist()], pa.string()),
                 *[table[c].combine_chunks().take(own) for c in ("turn", "from", "digest")]],
                names=["key", "place", "step", "edit", "role", "turn", "from", "digest"],
            )

    return kernel


def damage_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` with faults by the CRC-32 of ``conv:turn``: of twenty values 0 drops the row, 1 empties its
    text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's. NULL ids count as a space there; NULL roles and texts become one."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    fault = F.crc32(F.concat(own("conv"), F.lit(":"), own("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(own("text"), MARKS, "")).otherwise(own("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (
        slim.withColumn("fault", fault).filter("fault <> 0")
        .select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(own("role")).alias("role"), text.alias("text"), copies.alias("copy"))
        .drop("copy")
    )


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        row_key(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("from"), space(text_col).alias("text")
    ).withColumn("digest", F.md5(F.col("text").cast("binary")))


def place_rows(keyed: DataFrame) -> DataFrame:
    """The rows without their texts, each with its ``place`` in its conversation, its faults, ``kind`` and ``initial``.

    Equal rows are counted before they move and numbered again behind that; so a text that
    makes up much of a conversation is one row per turn when its first turn is looked for.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    once = staged(
        keyed.select("key", "turn", "from", "digest", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*MARKS)).alias("open"))
        .groupBy("key", "turn", "from", "digest", "blank", "open").agg(F.count("*").alias("times")),
        "chat-rows",
    )
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = once.groupBy("key", "from", "digest").agg(F.min(when).alias("earliest"), F.count("*").alias("turns")).filter("turns > 1").drop("turns")
    rows = (
        once.join(firsts, ["key", "from", "digest"], "left")
        .withColumn("again", F.coalesce(when > F.col("earliest"), F.lit(False)))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    )
    duplicate = ~F.col("blank") & (F.col("again") | (F.col("copy") > 1))
    initial = F.coalesce(F.element_at(F.create_map(*[x for i, c in enumerate("sua") for x in (F.lit(c), F.lit(i))]), F.substring("from", 1, 1)), F.lit(3))
    rows = rows.select("key", "turn", "from", "digest", "copy", "blank", duplicate.alias("duplicate"), "open", initial.alias("initial")).withColumns({
        "truncated": ~F.col("blank") & ~F.col("duplicate") & F.col("open"), "one": F.lit(1).cast("long"),
    })
    rows = rows.withColumn("kind", F.when(F.col("blank") | F.col("duplicate"), 0).otherwise(1 + 2 * F.col("initial") + F.col("truncated").cast("int")))
    order = [F.col("turn").asc_nulls_first(), F.col("from").asc(), F.col("digest").asc(), F.col("copy").asc()]
    return staged(running_totals(rows.drop("open"), ["key"], order, {"one": "place"}, "chat-order"), "chat-places")


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """Cheapest edits that bring the roles of each conversation into the form ``(s?(ua)+)?``, and what was wrong with it.

    Rows stand by turn, NULL first; those of one turn by role, then by the MD5 of their text. A row is
    blank (nothing but spaces), else a duplicate (same role and text earlier), else truncated (its
    last character but spaces is none of ``.!?``). Keeping it costs nothing (``K``), giving it the other
    role of user and assistant 3 (``R``), deleting it 4 (``D``, which blank rows and duplicates must be), an empty
    row inserted anywhere 3 (``I``), a truncated row that stays 3 more. Of the cheapest edits those
    whose letters come first are taken.

    Returns ``key`` (the id as a string, see ``row_key``), ``place``, ``step``, ``edit``, ``role``, ``text`` of every edit, in order of place and
    step, role and text as they are afterwards and NULL for deleted rows; and per ``key`` the
    ``gaps`` (turns missing between the least and the greatest), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbouring
    initials that are none of su, ua, au) and ``cost``. NULL ids are a conversation; NULL roles and texts are
    one space; an empty table gives none of both; other columns are left aside.

    A conversation of any length is cut into runs of ``run`` rows, so no task holds more than that
    of it. Only slim rows are sorted; a text moves once, to the edit that keeps it.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    placed = place_rows(keyed).withColumn("run", F.floor(F.col("place") / run).cast("long"))
    dealt = lambda df: df.repartition("key", "run").sortWithinPartitions("key", "run", "place")
    schema = "key string, run long, cost array<long>, place_of array<long>, first int, last int, illegal long"
    runs = staged(dealt(placed.select("key", "run", "place", "kind", "initial")).mapInArrow(_matrices(run), schema), "chat-matrices")
    states, solved = run_states(runs, fan)
    joined = placed.select("key", "run", "place", "kind", "turn", "from", "digest").join(states, ["key", "run"])
    edits = dealt(joined).mapInArrow(
        _rows_with_edits(run), "key string, place long, step int, edit string, role string, turn long, `from` string, digest string"
    )
    counted = lambda c: F.count_if(c).alias(c)
    faults = placed.groupBy("key").agg(F.count("*").alias("rows"), counted("blank"), counted("duplicate"), counted("truncated"))
    turns = placed.select("key", "turn").distinct().groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps")
    )
    follows = runs.select("key", "run", "first").join(runs.select("key", (F.col("run") + 1).alias("run"), "last"), ["key", "run"])
    legal = "(last = 0 and first = 1) or (last = 1 and first = 2) or (last = 2 and first = 1)"
    illegal = (
        runs.select("key", "illegal").unionByName(follows.select("key", F.expr(f"if({legal}, 0, 1)").cast("long").alias("illegal")))
        .groupBy("key").agg(F.sum("illegal").alias("illegal"))
    )
    report = staged(faults.join(turns, "key").join(illegal, "key").join(solved, "key"), "chat-report")
    closing = F.element_at(F.array(*[F.array(*[F.lit(r) for r in c]).cast("array<string>") for c in CLOSING]), (F.col("leave") + 1).cast("int"))
    behind = report.select("key", F.col("rows").alias("place"), F.posexplode(closing).alias("step", "role"))
    edits = staged(edits, "chat-edits")
    texts = keyed.select("key", "turn", "from", "digest", "text").dropDuplicates(["key", "turn", "from", "digest"])
    same = ["key", "from", "digest"]
    stays = edits.filter(F.col("edit").isin("K", "R")).alias("e").join(
        texts.alias("t"), [F.col(f"e.{c}") == F.col(f"t.{c}") for c in same] + [F.col("e.turn").eqNullSafe(F.col("t.turn"))]
    ).select("e.key", "e.place", "e.step", "e.edit", F.coalesce("e.role", "e.from").alias("role"), "t.text")
    others = edits.filter(F.col("edit").isin("D", "I")).select("key", "place", "step", "edit", "role", F.when(F.col("edit") == "I", "").alias("text"))
    ends = behind.select("key", "place", F.col("step").cast("int").alias("step"), F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    return stays.unionByName(others).unionByName(ends), report.drop("rows", "leave")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation of sorted edits, row by row; no conversation is held."""
    key, letters, digest, empty = None, [], hashlib.sha256(), True
    done: list[tuple[str, str, str]] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*done) if done else ([], [], []))], names=["key", "audit", "repaired_sha256"])
        done.clear()
        return made

    for batch in batches:
        for own, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if own != key:
                if key is not None:
                    done.append((key, "".join(letters), digest.hexdigest()))
                key, letters, digest, empty = own, [], hashlib.sha256(), True
            letters.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        letters = ["".join(letters)]
        yield out()
    if key is not None:
        done.append((key, "".join(letters), digest.hexdigest()))
    yield out()


def repair_digests(edits: DataFrame) -> DataFrame:
    """``key``, ``audit`` and the SHA-256 of the repaired conversation, a digest that only one pass in order can make."""
    ordered = edits.repartition("key").sortWithinPartitions("key", "place", "step")
    return ordered.select("key", "edit", "role", "text").mapInArrow(_digested, "key string, audit string, repaired_sha256 string")


def op11_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    edits, report = repair_conversations(damage_conversations(given), "conv")
    found = report.join(repair_digests(edits), "key")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (
        given.select("conv_id", row_key("conv_id").alias("key")).distinct().join(found, "key", "left")
        .select(
            "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


#: The inserts that lead from a state to another, and what a row of some initial, or a row given another role, leads to.
_INSERTS = ", ".join(
    f"({a}, {b}, '{'I' * len(roles)}', '{''.join(r + ':' + chr(10) for r in roles)}')"
    for a, b, roles in [
        (0, 0, ()), (0, 2, ("user",)), (0, 3, ("user", "assistant")), (1, 1, ()), (1, 2, ("user",)), (1, 3, ("user", "assistant")),
        (2, 2, ()), (2, 3, ("assistant",)), (2, 2, ("assistant", "user")), (3, 3, ()), (3, 2, ("user",)), (3, 3, ("user", "assistant")),
    ]
)
OP11_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT row_number() OVER () AS id, conv_id, coalesce(conv_id::VARCHAR, 'none') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), bits AS (  -- of each character its code, and then eight shifts
  SELECT *, flatten(list_transform(string_split(name, ''), lambda c: [ascii(c)::UBIGINT] || list_transform(range(8), lambda i: 256::UBIGINT))) AS steps FROM named
), hurt AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || steps,
    lambda a, b: CASE WHEN b < 256 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT) % 20 AS fault
  FROM bits
), rows AS (
  SELECT key, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hurt WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows
), seen AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS duplicate FROM placed
), judged AS (
  SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY key ORDER BY pos), 1) AS before, lag(pos) OVER (PARTITION BY key ORDER BY pos) IS NOT NULL AS later
  FROM seen
), counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (later AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY key
), inserts(state, ready, letters, lines) AS (VALUES {_INSERTS}
), keeps(initial, ready, after) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), reroles(role, ready, after) AS (VALUES ('user', 0, 2), ('user', 1, 2), ('assistant', 2, 3), ('user', 3, 2)
), steps AS (  -- what a row may become behind a state: cost, letter, line
  SELECT key, pos, ready, after, CASE WHEN truncated THEN 3 ELSE 0 END AS cost, 'K' AS letter, role || ':' || text || chr(10) AS line
  FROM judged JOIN keeps USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT key, pos, ready, after, CASE WHEN truncated THEN 6 ELSE 3 END, 'R', r.role || ':' || text || chr(10)
  FROM judged, reroles r WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT key, pos, state, state, 4, 'D', '' FROM judged, (VALUES (0), (1), (2), (3)) s(state)
), best AS (
  SELECT key, 0::BIGINT AS pos, 0 AS state, {{'cost': 0, 'audit': '', 'lines': ''}} AS own FROM counts
  UNION ALL
  SELECT b.key, s.pos, s.after, min({{'cost': b.own.cost + 3 * len(i.letters) + s.cost, 'audit': b.own.audit || i.letters || s.letter, 'lines': b.own.lines || i.lines || s.line}})
  FROM best b JOIN inserts i ON i.state = b.state JOIN steps s ON s.key = b.key AND s.pos = b.pos + 1 AND s.ready = i.ready
  GROUP BY b.key, s.pos, s.after
), ended AS (
  SELECT b.key, min({{'cost': b.own.cost + 3 * len(i.letters), 'audit': b.own.audit || i.letters, 'lines': b.own.lines || i.lines}}) AS own
  FROM best b JOIN counts c ON c.key = b.key AND c.n = b.pos JOIN inserts i ON i.state = b.state AND i.ready IN (0, 3) AND (i.ready = 3 OR i.state = 0) GROUP BY b.key
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(own.cost, 0)::BIGINT AS cost, coalesce(own.audit, '') AS audit,
  sha256(coalesce(left(own.lines, greatest(len(own.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM named) LEFT JOIN counts USING (key) LEFT JOIN ended USING (key)
"""
