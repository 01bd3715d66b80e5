"""Operator 5: benchmark decontamination by templates of typed placeholders."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fluxbook.llm.staging import staged, text_hash
from fluxbook.llm.texts import U64, lowered, map_texts, span_hashes, spans_of, windows

#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars "
    "euro euros pound pounds percent degree degrees mph kmh"
).split()
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_ALPHA = np.zeros(256, bool)
IS_ALPHA[65:91] = IS_ALPHA[97:123] = IS_ALPHA[128:] = True
IS_CAPITAL = np.zeros(256, bool)
IS_CAPITAL[65:91] = True
ENDS_SENTENCE = np.zeros(256, bool)
ENDS_SENTENCE[list(b".!?:\n|")] = True
NUMBER, UNIT, NAME = U64(1), U64(2), U64(3)
#: Marks the hash of a window that stands for its own values.
AS_IS = U64(0xA5A5A5A5A5A5A5A5)


@dataclass(frozen=True)
class TemplateSettings:
    """``width``: words of a window. ``least_words``: how many of them are no placeholders at
    least for a template; windows with fewer are held by their own values. ``share``: part of an item's windows that a text must hold, or ``run`` of them
    (windows of 8 that follow each other: run + 7 words). ``block``: windows of the benchmark
    looked up in one pass over the texts; a larger benchmark takes more passes."""

    width: int = 8
    least_words: int = 4
    share: float = 0.5
    run: int = 6
    block: int = 1 << 22


def canonical(data: np.ndarray, offsets: np.ndarray, names: np.ndarray):
    """Template of each row: code of each word, its value, its row, whether it is a placeholder, and the names found.

    Words are runs of letters or of digits; a point or comma between digits belongs to the
    number. Case and other marks are left out. Numbers, units behind numbers and names become
    placeholders. A name is a word with a capital and then small letters inside a sentence, or a
    word from ``names``, hashes of the benchmark's own names, in any case.
    """
    digit = IS_DIGIT[data]
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    letters, numbers = spans_of(IS_ALPHA[data], offsets), spans_of(digit | inner, offsets)
    starts = np.concatenate([letters[0], numbers[0]])
    order = np.argsort(starts, kind="stable")
    starts, ends, rows = starts[order], np.concatenate([letters[1], numbers[1]])[order], np.concatenate([letters[2], numbers[2]])[order]
    is_number = (np.arange(len(order)) >= len(letters[0]))[order]
    value = span_hashes(lowered(data), starts, ends)
    inside = np.zeros(len(starts), bool)  # has a word before it in its sentence
    inside[1:] = rows[1:] == rows[:-1]
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ENDS_SENTENCE[data], out=stops[1:])
    inside[1:] &= stops[starts[1:]] == stops[ends[:-1]]
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    named = ~is_number & inside & IS_CAPITAL[data[starts]] & (ends - starts > 1) & (second >= 97)
    found = np.unique(value[named])
    is_name = named | (~is_number & np.isin(value, names))
    unit_text = " ".join(UNITS).encode()
    unit_data = np.frombuffer(unit_text, np.uint8)
    unit_spans = spans_of(unit_data != 32, np.array([0, len(unit_data)]))
    is_unit = np.zeros(len(starts), bool)
    is_unit[1:] = ~is_number[1:] & is_number[:-1] & (rows[1:] == rows[:-1])
    is_unit &= np.isin(value, span_hashes(unit_data, unit_spans[0], unit_spans[1]))
    code = np.where(is_number, NUMBER, np.where(is_unit, UNIT, np.where(is_name, NAME, value)))
    return code, value, rows, is_number | is_unit | is_name, found


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def template_windows(code, value, rows, slot, widths, settings: TemplateSettings, n_rows: int, wanted: np.ndarray | None):
    """Per row lists of window hashes, their places, and their placeholders' values.

    A window with too few plain words would fit any text as a template; it stands for its own values, has
    no placeholders then, and is left out only where it is a whole short item. With ``wanted``,
    sorted hashes, only windows among them are listed.
    """
    hashes, at, sizes, dense = [], [], [], []
    plain = np.concatenate([[0], np.cumsum(~slot)])
    length = np.bincount(rows, minlength=n_rows)
    for width in widths:
        keys, places = windows(code, rows, width)
        few = plain[places + width] - plain[places] < settings.least_words
        ok = np.ones(len(keys), bool)
        if width == settings.width:
            keys = np.where(few, windows(value, rows, width)[0] ^ AS_IS, keys)
        else:
            ok = ~few
        if wanted is not None:
            near = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
            ok &= wanted[near] == keys if len(wanted) else False
        hashes.append(keys[ok]), at.append(places[ok]), sizes.append(np.full(int(ok.sum()), width)), dense.append(few[ok])
    hashes, at, sizes, dense = (np.concatenate(x) for x in (hashes, at, sizes, dense))
    order = np.argsort(at, kind="stable")
    hashes, at, sizes, dense = hashes[order], at[order], sizes[order], dense[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    per_row = np.bincount(rows[at], minlength=n_rows)
    slots = np.concatenate([[0], np.cumsum(slot)])
    n_slots = np.where(dense, 0, slots[at + sizes] - slots[at])
    values = value[slot].view(np.int64)
    taken = np.repeat(slots[at] - np.concatenate([[0], np.cumsum(n_slots)[:-1]]) if len(at) else at, n_slots) + np.arange(int(n_slots.sum()))
    return (
        _lists(per_row, pa.array(hashes.view(np.int64))), _lists(per_row, pa.array((at - first[rows[at]]).astype(np.int32))),
        _lists(per_row, _lists(n_slots, pa.array(values[taken]))), length,
    )


LISTS = T.StructType([
    T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    T.StructField("slots", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("n_words", T.LongType()),
])


def _kernel(names: np.ndarray, widths: list[int] | None, settings: TemplateSettings, wanted: np.ndarray | None):
    def kernel(batch, first, end, data, offsets):
        code, value, rows, slot, _ = canonical(data, offsets, names)
        own = widths
        if own is None:  # a benchmark: its usual windows, and each short item as a whole
            length = np.bincount(rows, minlength=end - first)
            own = sorted({settings.width} | set(length[(length > 0) & (length < settings.width)].tolist()))
        made = template_windows(code, value, rows, slot, own, settings, end - first, wanted)
        if widths is None:
            short = made[3] < settings.width
            if short.any() and len(own) > 1:  # keep of a short item only the window over all its words, of a long one the usual
                parts = [template_windows(code, value, rows, slot, [w], settings, end - first, None) for w in own]
                pick = {w: p for w, p in zip(own, parts)}
                columns = []
                for k in range(3):
                    columns.append(pa.array([pick[min(int(n), settings.width)][k][i].as_py() if n else [] for i, n in enumerate(made[3])], made[k].type))
                made = (*columns, made[3])
        return dict(zip(LISTS.names, made))

    return kernel


def _names(names_of: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the names that the benchmark itself shows by their capitals."""

    def start():
        def kernel(batch, first, end, data, offsets):
            found = [canonical(data[a:b], np.array([0, b - a]), np.zeros(0, U64))[4] for a, b in zip(offsets[:-1], offsets[1:])]
            return {"names": pa.array([f.view(np.int64).tolist() for f in found], pa.list_(pa.int64()))}

        return kernel

    made = map_texts(names_of, text_col, [], T.StructType([T.StructField("names", T.ArrayType(T.LongType()))]), start)
    return np.sort(made.select(F.explode("names").alias("name")).distinct().toPandas()["name"].to_numpy(np.int64).view(U64))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", settings: TemplateSettings = TemplateSettings(),
) -> DataFrame:
    """``row`` (a number of the input row), the id, ``text_hash``, ``contaminated``, ``n_items``, ``item`` (the smallest one held),
    ``matched`` (most windows of an item) and ``same_slots`` (an item is held with its own values).

    Texts and benchmark items become templates. Windows of the benchmark are looked up in every
    whole text; the hits are joined with the items by hash. Along one alignment the placeholders
    must map one to one: an item's value always to the same value of the text, and back. Windows
    with a placeholder that breaks this do not count. A text is contaminated if it holds enough
    different windows of an item.

    NULL and empty texts hold nothing, NULL and empty items are held by nobody, an item shorter
    than a window is one window of its own; if it has fewer than ``least_words`` plain words as well, it is
    too short to be told and held by nobody; with an empty benchmark all texts are clean. Repeated
    rows and NULL ids are judged each. Other columns are left aside.
    """
    spark = docs.sparkSession
    names = _names(benchmark, item_text_col)
    items = staged(
        map_texts(benchmark.withColumn("_item", F.col(item_col)), item_text_col, ["_item"], LISTS, lambda: _kernel(names, None, settings, None))
        .withColumn("item_row", F.monotonically_increasing_id()),
        "template-items",
    )
    hits_of = lambda df, *keys: df.select(*keys, F.explode(F.arrays_zip("windows", "places", "slots")).alias("h"))
    item_windows = hits_of(items, F.col("_item").alias("item"), "item_row", F.size("windows").alias("n_windows")).select(
        "item", "item_row", "n_windows", F.col("h.windows").alias("window"), F.col("h.places").alias("item_place"), F.col("h.slots").alias("item_slots")
    )
    widths = [settings.width] + sorted(r[0] for r in items.filter((F.col("n_words") > 0) & (F.col("n_words") < settings.width)).select("n_words").distinct().collect())
    hashes = item_windows.select("window").distinct()
    passes = max(1, -(-hashes.count() // settings.block))
    found, row = None, F.monotonically_increasing_id()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    if passes > 1:  # all passes read the rows with the numbers that were written once
        chosen, row = staged(chosen.withColumn("row", row), "template-rows"), F.col("row")
    kept = [c for c in chosen.columns if c != "text"]
    for k in range(passes):
        part = hashes.filter(F.pmod("window", F.lit(passes)) == k) if passes > 1 else hashes
        wanted = spark.sparkContext.broadcast(np.sort(part.toPandas()["window"].to_numpy(np.int64).view(U64)))
        one = map_texts(chosen, "text", kept, LISTS, lambda wanted=wanted: _kernel(names, widths, settings, wanted.value))
        one = staged(one.withColumn("row", row).drop("n_words"), f"template-hits-{k}")
        found = one if found is None else found.unionByName(one)
    rows = (found if passes == 1 else chosen).select("row", "id", "text_hash")
    hits = hits_of(found.filter(F.size("windows") > 0), "row").select(
        "row", F.col("h.windows").alias("window"), F.col("h.places").alias("place"), F.col("h.slots").alias("doc_slots")
    )
    aligned = staged(
        hits.join(item_windows, "window").select("row", "item", "item_row", "n_windows", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), "doc_slots", "item_slots"),
        "template-aligned",
    )
    along = ["row", "item_row", "shift"]
    slots = aligned.select(*along, "item_place", F.explode(F.arrays_zip("doc_slots", "item_slots")).alias("s")).select(*along, "item_place", "s.doc_slots", "s.item_slots")
    pairs = slots.select(*along, "doc_slots", "item_slots").distinct()
    clash = lambda side: pairs.groupBy(*along, side).count().filter("count > 1").drop("count")
    torn = slots.join(clash("doc_slots"), [*along, "doc_slots"], "left_semi").unionByName(
        slots.join(clash("item_slots"), [*along, "item_slots"], "left_semi"), allowMissingColumns=True
    ).select(*along, "item_place").distinct()
    held = (
        aligned.join(torn, [*along, "item_place"], "left_anti").groupBy("row", "item_row")
        .agg(F.first("item").alias("item"), F.first("n_windows").alias("n_windows"), F.count_distinct("item_place").alias("matched"),
             F.min(F.col("doc_slots") == F.col("item_slots")).alias("same"))
        .filter((F.col("matched") >= settings.run) | (F.col("matched") >= settings.share * F.col("n_windows")))
        .groupBy(F.col("row").alias("_row"))
        .agg(F.count("*").alias("n_items"), F.min("item").alias("item"), F.max("matched").alias("matched"), F.max("same").alias("same_slots"))
    )
    return rows.join(held, F.col("row") == F.col("_row"), "left").select(
        "row", F.col("id").alias(id_col), "text_hash", F.col("_row").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "item", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), "same_slots",
    )


def op5_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.drop("row", "text_hash").withColumnRenamed("item", "item_id")
