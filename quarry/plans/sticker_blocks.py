"""Blocks of a window sticker from its words and their places: overview, the equipment grid of four columns, optional equipment, warranties
and prices.

A sticker is one row with its words as an array (a printed page holds a few hundred); rows of words, columns and items are made by folds and
filters over it, so any number of stickers needs the one shuffle that gathers words. Blocks that lie side by side at the same height are cut by
x before their words are grouped into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import titled
from quarry.sources.tables import spread, table

WORD = "struct<x:double,y:double,text:string>"
# Headers of the equipment grid and the names of their lists.
COLUMNS = {"EXTERIOR": "exterior", "INTERIOR": "interior", "FUNCTIONAL": "functional_tech", "SAFETY/SECURITY": "safety_security"}
# Prices and the labels before them.
PRICES = {"base_price": ["BASE", "PRICE"], "destination_and_delivery": ["DESTINATION", "&", "DELIVERY"], "total_vehicle_and_options": ["TOTAL", "VEHICLE", "&", "OPTIONS/OTHER"], "total_msrp": ["TOTAL", "MSRP"]}
GOES_ON, CONTINUES = r"[,:\-/&]\s*$", r"^[-/&:,]"
WARRANTY = r"^(\d+)YR/([\d,]+)\s+(.*)"
GARBAGE = r"[\x00-\x1f\x7f-\x9f\ue000-\uf8ff]"


def readable(text: Column) -> Column:
    """Whether a word is text: neither blank nor in a symbol font (private or control characters)."""
    return (F.trim(text) != "") & ~text.rlike(GARBAGE)


def word_rows(words: Column, tolerance: float = 1.5) -> Column:
    """Rows of words by height: a word joins the row above if it is within the tolerance of that row's first word. Words in a row by x."""
    by_height = F.transform(F.sort_array(F.transform(words, lambda w: F.struct(w["y"].alias("y"), w["x"].alias("x"), w["text"].alias("text")))), lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["text"].alias("text")))

    def add(rows: Column, w: Column) -> Column:
        last = F.element_at(rows, -1)
        joins = F.abs(w["y"] - last[0]["y"]) <= tolerance
        return F.when((F.size(rows) > 0) & joins, F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(F.concat(last, F.array(w))))).otherwise(F.concat(rows, F.array(F.array(w))))

    # The row under construction keeps its first word first, as it decides; rows are put in order of x at the end.
    grouped = F.aggregate(by_height, F.array().cast(f"array<array<{WORD}>>"), lambda rows, w: F.when(F.size(rows) == 0, F.array(F.array(w))).otherwise(add(rows, w)))
    return F.transform(grouped, lambda row: F.sort_array(row))


def _text(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda w: w["text"]), " ")


def _let(value: Column, use) -> Column:
    """`use` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upper(row: Column) -> Column:
    return F.transform(row, lambda w: F.upper(w["text"]))


def has_all(upper: Column, *texts: str) -> Column:
    """Whether all the texts are among a row's words in capitals."""
    return F.size(F.array_except(F.array(*map(F.lit, texts)), upper)) == 0


def first_row(rows: Column, fits) -> Column:
    return F.get(F.filter(rows, fits), F.lit(0))


def _starts(upper: Column, *texts: str) -> Column:
    return F.slice(upper, 1, len(texts)) == F.array(*map(F.lit, texts))


def merged(lines: Column) -> Column:
    """Lines, with one that goes on glued to the next: it ends open, or the next begins with a mark that continues."""
    ends = lambda items: F.element_at(items, -1)
    glued = lambda items, line: F.concat(F.slice(items, F.lit(1), F.size(items) - 1), F.array(F.concat(ends(items), F.lit(" "), line)))
    add = lambda items, line: F.when(ends(items).rlike(GOES_ON) | line.rlike(CONTINUES), glued(items, line)).otherwise(F.concat(items, F.array(line)))
    return F.aggregate(lines, F.array().cast("array<string>"), lambda items, line: F.when(F.size(items) == 0, F.array(line)).otherwise(add(items, line)))


def warranty(raw: Column) -> Column:
    """`3YR/36,000 BUMPER / BUMPER` as `3-Year / 36,000-Mile Bumper-to-Bumper`; other lines in title case."""
    label = F.trim(F.replace(F.regexp_extract(raw, WARRANTY, 3), F.lit("BUMPER / BUMPER"), F.lit("Bumper-to-Bumper")))
    first, shouted = F.substring(label, 1, 1), (F.upper(label) == label) & (F.lower(label) != label)
    small = (label != "") & ~((F.upper(first) == first) & (F.lower(first) != first))
    shown = F.regexp_replace(F.when(small | shouted, titled(label)).otherwise(label), r" -(\S)", " - $1")
    return F.when(raw.rlike(WARRANTY), F.concat(F.regexp_extract(raw, WARRANTY, 1), F.lit("-Year / "), F.regexp_extract(raw, WARRANTY, 2), F.lit("-Mile "), shown)).otherwise(titled(raw))


def _within(words: Column, low: Column, high: Column, left: Column | None, right: Column) -> Column:
    return F.filter(words, lambda w: (w["y"] > low) & (w["y"] < high) & (w["x"] < right) & (F.lit(True) if left is None else w["x"] > left))


def _kinds(block: Column) -> Column:
    """kind and text of each row of the overview but the first."""

    def told(t: Column) -> Column:
        up = F.upper(t)
        kind = F.when(t.rlike(r"^\d{4}\b"), "trim_drivetrain").when(up.contains("PASSENGER"), "seating_capacity").when(up.contains("ENGINE") | up.rlike(r"\bECOBOOST\b"), "engine")
        return F.struct(kind.when(up.contains("TRANSMISSION") | up.rlike(r"\bAUTO\b|\bMANUAL\b"), "transmission").alias("kind"), t.alias("text"))

    return F.transform(F.transform(F.slice(block, 2, 10_000), _text), told)


def _overview(block: Column, colours: Column) -> dict[str, Column]:
    last = lambda name: titled(F.try_element_at(F.filter("kinds", lambda r: r["kind"] == name), F.lit(-1))["text"])

    def under(label: str) -> Column:
        at = first_row(colours, lambda r: (F.size(r) == 1) & (F.upper(r[0]["text"]) == label))
        return titled(_text(first_row(colours, lambda r: (r[0]["y"] > at[0]["y"]) & (r[0]["y"] < at[0]["y"] + 15))))

    return {
        "model_line": titled(_text(F.get(block, F.lit(0)))),
        **{name: last(name) for name in ("trim_drivetrain", "seating_capacity", "engine", "transmission")},
        "exterior_color": under("EXTERIOR"),
        "interior_trim": under("INTERIOR"),
    }


def blocks(words: DataFrame, key: str) -> DataFrame:
    """One row per sticker from words (key, x, y, text): overview (struct), equipment (column -> items), optional_equipment, warranties, pricing (struct).
    What isn't there is null or empty."""
    good = words.where(readable(F.col("text")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    word = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("text").alias("text"))
    page = good.groupBy(key).agg(F.collect_list(word).alias("words")).withColumn("rows", word_rows(F.col("words")))
    rows, all_words, told = F.col("rows"), F.col("words"), F.col("told")
    page = page.withColumn("told", F.transform(rows, lambda r: F.struct(_upper(r).alias("up"), r.alias("row"))))
    height = lambda found: found["row"][0]["y"]

    # Places of the headers.
    page = page.withColumns(
        {
            "top": height(first_row(told, lambda r: has_all(r["up"], "VEHICLE", "DESCRIPTION"))),
            "grid_top": height(first_row(told, lambda r: has_all(r["up"], "STANDARD", "EQUIPMENT"))),
            "grid": first_row(told, lambda r: has_all(r["up"], "EXTERIOR", "INTERIOR", "FUNCTIONAL") & F.exists(r["up"], lambda t: t.contains("SAFETY")))["row"],
            "grid_end": F.coalesce(height(first_row(told, lambda r: has_all(r["up"], "INCLUDED", "ON", "THIS", "VEHICLE"))), F.lit(1e9)),
            "extras": height(first_row(told, lambda r: F.array_contains(r["up"], "OPTIONAL") & F.exists(r["up"], lambda t: t.contains("EQUIPMENT")))),
            "sold": height(first_row(told, lambda r: _starts(r["up"], "SOLD", "TO"))),
            "prices_x": first_row(told, lambda r: _starts(r["up"], "PRICE", "INFORMATION"))["row"][0]["x"],
        }
    )
    bottom = F.coalesce("grid_top", F.col("top") + 90)
    page = page.withColumns(
        {
            "block": word_rows(_within(all_words, F.col("top"), bottom, None, F.lit(420.0))),
            "colours": word_rows(_within(all_words, F.col("top"), bottom, F.lit(420.0), F.lit(620.0))),
            "extra_rows": word_rows(_within(all_words, F.col("extras"), F.coalesce("sold", F.col("extras") + 70), None, F.coalesce(F.col("prices_x") - 5, F.lit(450.0)))),
            "heads": F.array_sort(F.transform(F.filter("grid", lambda w: F.upper(w["text"]).isin(*COLUMNS)), lambda w: F.struct(w["x"].alias("x"), F.upper(w["text"]).alias("label")))),
        }
    )
    # Columns reach to the next header; the last is as wide as the one before it.
    n = F.size("heads")
    width = F.when(n > 1, F.element_at("heads", -1)["x"] - F.get("heads", n - 2)["x"]).otherwise(160.0)
    bound = lambda h, i: F.struct(h["label"].alias("label"), (h["x"] - 2).alias("low"), (F.coalesce(F.get("heads", i + 1)["x"], h["x"] + width) - 2).alias("high"))
    grid_y = F.col("grid")[0]["y"]
    cell = lambda r, b: F.filter(r, lambda w: (w["x"] >= b["low"]) & (w["x"] < b["high"]))
    body = lambda b: F.filter(rows, lambda r: (r[0]["y"] > grid_y) & (r[0]["y"] < F.col("grid_end")) & (F.size(cell(r, b)) > 0))
    # A row holds all columns, so its height is the row's; only its words in the column are the item.
    page = page.withColumn("bounds", F.transform("heads", bound))
    # Where the warranties begin is found once for a column.
    page = page.withColumns({"kinds": _kinds(F.col("block")), "columns": F.transform("bounds", lambda b: F.struct(b["label"].alias("label"), F.transform(body(b), lambda r: F.struct(r[0]["y"].alias("y"), F.exists(r, lambda w: F.upper(w["text"]) == "WARRANTY").alias("mark"), _text(cell(r, b)).alias("text"))).alias("lines")))})
    page = page.withColumn("parts", F.transform("columns", lambda p: F.struct(p["label"].alias("label"), p["lines"].alias("lines"), F.get(F.filter(p["lines"], lambda x: x["mark"]), F.lit(0))["y"].alias("mark"))))
    mark = lambda p: p["mark"]
    texts = lambda lines: F.filter(F.transform(lines, lambda x: x["text"]), lambda t: F.trim(t) != "")
    items = lambda p: F.transform(merged(texts(F.filter(p["lines"], lambda x: mark(p).isNull() | (x["y"] < mark(p))))), titled)
    label = F.create_map(*(F.lit(v) for kv in COLUMNS.items() for v in kv))
    page = page.withColumns(
        {
            "equipment": F.map_from_entries(F.transform("parts", lambda p: F.struct(label[p["label"]].alias("key"), items(p).alias("value")))),
            "marked": F.try_element_at(F.filter("parts", lambda p: mark(p).isNotNull()), F.lit(-1)),
            "extra_lines": F.transform("extra_rows", lambda r: F.ltrim(F.trim(_text(r)), F.lit("."))),
            **{f"_{k}": c for k, c in _overview(F.col("block"), F.col("colours")).items()},
        }
    )
    vin = F.regexp_extract(F.array_join(F.transform(F.flatten("rows"), lambda w: w["text"]), " "), r"\b([A-HJ-NPR-Z0-9]{17})\b", 1)
    trim = F.split("_trim_drivetrain", " ")
    model = F.concat(trim[0], F.lit(" "), "_model_line", F.lit(" "), F.array_join(F.slice(trim, 2, 100), " "))
    fields = ("model_line", "trim_drivetrain", "seating_capacity", "engine", "transmission", "exterior_color", "interior_trim")
    overview = F.struct(F.when(vin != "", vin).alias("vin"), *(F.col(f"_{f}").alias(f) for f in fields), model.alias("model"))
    lines = F.when(F.col("marked").isNotNull(), merged(texts(F.filter(F.col("marked.lines"), lambda x: x["y"] > mark(F.col("marked"))))))
    return page.select(
        key,
        overview.alias("overview"),
        F.coalesce("equipment", F.create_map().cast("map<string,array<string>>")).alias("equipment"),
        F.coalesce(F.transform(F.filter("extra_lines", lambda t: (t != "") & ~F.upper(t).contains("NO CHARGE")), titled), F.array().cast("array<string>")).alias("optional_equipment"),
        F.coalesce(F.transform(lines, warranty), F.array().cast("array<string>")).alias("warranties"),
        F.struct(*(_price(told, label).alias(name) for name, label in PRICES.items())).alias("pricing"),
    )


def _price(told: Column, label: list[str]) -> Column:
    """The first amount that follows the label in its row (row, and up: its words in capitals); of several rows with the label the first that has one."""
    size, wanted = len(label), F.array(*map(F.lit, label))

    def amount(r: Column) -> Column:
        row = r["row"]
        at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(row), F.lit(1))), lambda i: F.slice(r["up"], i, size) == wanted), F.lit(0))
        after = lambda at: F.when(at.isNotNull(), F.slice(row, at + size, F.greatest(F.size(row) - at - size + 1, F.lit(0))))
        first = F.get(F.filter(F.transform(_let(at, after), lambda w: w["text"]), lambda t: F.btrim(t, F.lit("$")).rlike(r"^[\d,]+\.\d{2}$")), F.lit(0))
        return F.when(F.array_contains(r["up"], label[0]), first)

    found = F.get(F.filter(F.transform(told, amount), lambda a: a.isNotNull()), F.lit(0))
    return _let(found, lambda a: F.when(a.startswith("$"), a).otherwise(F.concat(F.lit("$"), a)))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """A sticker for each part: its name, type and brand are printed as equipment; heights and columns are moved by its size."""
    p = spread(table(spark, d, "part").where("p_partkey IS NOT NULL"))
    up, dx, dy = F.upper("p_name"), (F.col("p_size") % 5) * 2.0, (F.col("p_partkey") % 3) * 0.5
    w = lambda x, y, t: F.struct((F.lit(x) + dx).alias("x"), (F.lit(y) + dy).alias("y"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    line = lambda x, y, text: F.transform(F.split(text, " "), lambda t, i: F.struct((F.lit(x) + dx + i * 12.0).alias("x"), (F.lit(y) + dy).alias("y"), t.alias("text")))
    text = lambda *parts: F.concat(*(F.lit(q) if isinstance(q, str) else q for q in parts))
    size = F.col("p_size").cast("string")
    lines = [
        line(30.0, 40.0, text("VEHICLE DESCRIPTION")), line(30.0, 52.0, up), line(30.0, 62.0, text("2024 ", F.upper("p_type"), " TRIM")), line(30.0, 72.0, text(size, " PASSENGER")),
        line(30.0, 82.0, text("2.0L ECOBOOST")), line(30.0, 92.0, text("10-SPEED AUTO")), F.array(w(440.0, 52.0, "EXTERIOR")), line(440.0, 62.0, text(up, " PAINT")), F.array(w(440.0, 72.0, "INTERIOR")), line(440.0, 82.0, text("BLACK ", F.upper("p_type"))),
        line(30.0, 110.0, text("STANDARD EQUIPMENT")), F.array(w(30.0, 125.0, "EXTERIOR"), w(180.0, 125.0, "INTERIOR"), w(330.0, 125.0, "FUNCTIONAL"), w(480.0, 125.0, "SAFETY/SECURITY")),
        line(30.0, 140.0, text(up, ",")), line(30.0, 150.0, text("HEATED")), line(180.0, 140.0, text("SEATS ", size)), line(330.0, 140.0, text(F.upper("p_brand"))), line(330.0, 150.0, text("-IF EQUIPPED")),
        line(480.0, 140.0, text("AIRBAGS")), F.array(w(480.0, 160.0, "WARRANTY")), line(480.0, 170.0, text(size, "YR/36,000 BUMPER / BUMPER")), line(480.0, 180.0, text("ROADSIDE")),
        line(30.0, 200.0, text("INCLUDED ON THIS VEHICLE")), line(400.0, 206.0, text("PRICE INFORMATION")), line(30.0, 212.0, text("OPTIONAL EQUIPMENT/OTHER")), line(30.0, 224.0, text(".", up, " PACKAGE")), line(30.0, 236.0, text("MATS NO CHARGE")),
        line(420.0, 224.0, text("BASE PRICE $", F.format_number("p_retailprice", 2))), line(420.0, 236.0, text("TOTAL MSRP ", F.format_number("p_retailprice", 2))), line(30.0, 260.0, text("SOLD TO")), line(30.0, 270.0, text("1FTEW1E50MFA", F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0"))), F.array(w(700.0, 10.0, "\ue012"), w(720.0, 10.0, "\x9f")),
    ]
    return p.select("p_partkey", F.inline(F.concat(*lines)))


def q_sticker_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(_words(spark, d), "p_partkey")
    listed = lambda c: F.array_join(c, " | ")
    return b.select("p_partkey", "overview.*", *(listed(F.col("equipment")[v]).alias(v) for v in COLUMNS.values()), listed("optional_equipment").alias("optional_equipment"), listed("warranties").alias("warranties"), "pricing.base_price", "pricing.total_msrp")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"

ORACLES = {
    "sticker_blocks": f"""WITH p AS (SELECT *, {_TITLE.format("p_name")} AS name, {_TITLE.format("p_type")} AS kind, regexp_replace({_TITLE.format("p_brand")}, '#', '#') AS brand, format('{{:,.2f}}', p_retailprice) AS price FROM part)
        SELECT p_partkey, '1FTEW1E50MFA' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS vin, name AS model_line, '2024 ' || kind || ' Trim' AS trim_drivetrain, p_size || ' Passenger' AS seating_capacity, '2.0L Ecoboost' AS engine, '10-Speed Auto' AS transmission,
            name || ' Paint' AS exterior_color, 'Black ' || kind AS interior_trim, '2024 ' || name || ' ' || kind || ' Trim' AS model, name || ', Heated' AS exterior, 'Seats ' || p_size AS interior, brand || ' -If Equipped' AS functional_tech, 'Airbags' AS safety_security,
            name || ' Package' AS optional_equipment, p_size || '-Year / 36,000-Mile Bumper-to-Bumper | Roadside' AS warranties, '$' || price AS base_price, '$' || price AS total_msrp FROM p""",
}
