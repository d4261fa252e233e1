"""Table grids: cells with spans to slots, overlaps, headers by containment, and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import sizing

#: Slots of one cell at most; larger spans are an error of the source.
MOST_SLOTS = 100_000


def slots(cells: DataFrame) -> DataFrame:
    """cells: tbl, cell, row, col, row_span, col_span, text -> one row per covered slot."""
    fits = F.col("row_span") * F.col("col_span") <= MOST_SLOTS
    rows = F.sequence(F.col("row"), F.col("row") + F.when(fits, F.col("row_span")).otherwise(F.raise_error(F.lit("cell spans too many slots")).cast("int")) - 1)
    return cells.withColumn("r", F.explode(rows)).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))


def overlaps(cells: DataFrame) -> DataFrame:
    """Slots that several cells claim."""
    return slots(cells).groupBy("tbl", "r", "c").agg(F.count_distinct("cell").alias("cells")).filter("cells > 1")


def observations(cells: DataFrame, header_rows: int = 1, stub_columns: int = 1) -> DataFrame:
    """Body cells with the header of their column and the stub of their row, the value state and the exact value. Headers
    meet bodies on the slots they cover (an equi-join per table), a header over several columns reaches each."""
    grid = slots(cells)
    head = grid.filter((F.col("r") < header_rows) & (F.col("c") >= stub_columns)).groupBy("tbl", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("r", "text"))), lambda x: x["text"]), " / ").alias("header"))
    stub = grid.filter((F.col("c") < stub_columns) & (F.col("r") >= header_rows)).groupBy("tbl", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("c", "text"))), lambda x: x["text"]), " / ").alias("metric"))
    body = grid.filter((F.col("r") >= header_rows) & (F.col("c") >= stub_columns)).select("tbl", "cell", "r", "c", "text")
    state = T.value_state(F.col("text"))
    out = body.join(head, ["tbl", "c"], "left").join(stub, ["tbl", "r"], "left")
    resolved = F.when((state == "present") & (F.col("header").isNull() | F.col("metric").isNull()), "unreadable").otherwise(state)
    return out.select("tbl", "cell", "r", "c", "header", "metric", resolved.alias("state"), F.when(resolved == "present", T.number_literal(F.col("text"))).alias("value"))


def headers(cells: DataFrame) -> DataFrame:
    """tbl, cell, header, role of each cell and its headers: column_header (in the header rows, above the cell, and its
    columns hold the cell's), else row_header (left of the cell in a stub column, and its rows hold the cell's) or
    row_qualifier (the same in any other column). How many rows are header says the cell in the table's first corner; a column
    whose cell in the first row is as deep as that, and the first column, are stubs.

    A cell is posted on each row it covers, a header also on each column; it asks on its own first row and column only, so
    a pair meets once. The cells of a line are one window: all of it needs one shuffle by table."""
    axes = ("row", "col")
    whole = Window.partitionBy("tbl")
    c = cells.select("tbl", "cell", "row", "col", "row_span", "col_span").withColumns({f"_{x}": F.min(x).over(whole) for x in axes})
    first = F.col("row") == F.col("_row")
    c = c.withColumn("_depth", F.coalesce(F.max(F.when(first & (F.col("col") == F.col("_col")), F.col("row_span"))).over(whole), F.lit(1)))
    c = c.withColumn("_stubs", F.collect_set(F.when(first & (F.col("row_span") == F.col("_depth")), F.col("col"))).over(whole))
    above = F.col("row") + F.col("row_span") <= F.col("_row") + F.col("_depth")
    c = c.withColumns({"stub": F.array_contains("_stubs", F.col("col")) | (F.col("col") == F.col("_col")), "above": F.coalesce(above, F.lit(False))})
    fits = F.col("row_span") * F.col("col_span") <= MOST_SLOTS
    span = lambda a: F.sequence(F.col(a), F.col(a) + F.when(fits, F.col(f"{a}_span")).otherwise(F.raise_error(F.lit("cell spans too many slots")).cast("int")) - 1)
    kept = ("tbl", "cell", "row", "col", "row_span", "col_span", "stub", "above")
    lines = c.select(*kept, F.explode(F.array(F.lit(True), F.lit(False))).alias("by_row"))
    lines = lines.select(*kept, "by_row", F.explode(F.when(F.col("by_row"), span("row")).when(F.col("above"), span("col")).otherwise(F.array("col"))).alias("line"))
    header = F.when(F.col("by_row") | F.col("above"), F.struct("cell", "row", "col", "row_span", "col_span", "stub"))
    lines = lines.withColumn("_headers", F.collect_list(header).over(Window.partitionBy("tbl", "by_row", "line")))
    own = lines.filter(F.col("line") == F.when(F.col("by_row"), F.col("row")).otherwise(F.col("col")))
    met = own.select("tbl", "cell", "row", "col", "row_span", "col_span", "by_row", F.explode("_headers").alias("h"))
    held = lambda x: (F.col(f"h.{x}") <= F.col(x)) & (F.col(x) + F.col(f"{x}_span") <= F.col(f"h.{x}") + F.col(f"h.{x}_span"))
    before = lambda x: F.col(f"h.{x}") + F.col(f"h.{x}_span") <= F.col(x)
    met = met.filter(F.when(F.col("by_row"), held("row") & before("col")).otherwise(held("col") & before("row")))
    role = F.when(~F.col("by_row"), "column_header").when(F.col("h.stub"), "row_header").otherwise("row_qualifier")
    return met.select("tbl", "cell", F.col("h.cell").alias("header"), role.alias("role"))


#: Rows and columns of a table that is laid out as text.
MOST_ROWS, MOST_COLUMNS = 500, 100


def laid_out(cells: DataFrame) -> DataFrame:
    """tbl, cell, row, col, row_span, col_span, text, start, end, row_start, row_end, status: each table as text, one line a
    row with tabs between its columns, and the place of every cell in it. A cell stands at its first slot; slots that no
    cell starts in are empty. status: ok, or why a table has no text (same_slot, too_large); such cells have null places.

    Running sums of the lengths before a cell give its place, so no text is built for that; `laid_out_text` builds it."""
    c = _measured(cells)
    order = Window.partitionBy("tbl").orderBy("row", "col")
    before = F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows_before = F.coalesce(F.sum("_len").over(Window.partitionBy("tbl").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_row = F.sum("_len").over(Window.partitionBy("tbl", "row"))
    ends = F.col("row") * F.col("_cols")  # each row has its columns' tabs and one line end, but for the last tab
    c = c.withColumn("start", (before + ends + F.col("col")).cast("int")).withColumn("row_start", (rows_before + ends).cast("int"))
    c = c.withColumn("row_end", (F.col("row_start") + in_row + F.col("_cols") - 1).cast("int")).withColumn("end", F.col("start") + F.col("_len"))
    place = [F.when(F.col("status") == "ok", F.col(x)).alias(x) for x in ("start", "end", "row_start", "row_end")]
    return c.select("tbl", "cell", "row", "col", "row_span", "col_span", "text", *place, "status")


def _measured(cells: DataFrame) -> DataFrame:
    """cells with _rows, _cols and status of their table, _len of their text, and _row and _col, where the cell before
    starts (0, 0 for a table's first). All are windows in one order, so that the cells of a table are sorted once."""
    order, whole = Window.partitionBy("tbl").orderBy("row", "col"), Window.partitionBy("tbl")
    c = cells.withColumn("_len", F.char_length("text")).withColumns({f"_{x}": F.lag(x).over(order) for x in ("row", "col")})
    same = F.coalesce((F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col")), F.lit(False))
    c = c.withColumns({"_same": F.bool_or(same).over(whole), "_rows": F.max(F.col("row") + F.col("row_span")).over(whole), "_cols": F.max(F.col("col") + F.col("col_span")).over(whole)})
    status = F.when(F.col("_same"), "same_slot").when((F.col("_rows") > MOST_ROWS) | (F.col("_cols") > MOST_COLUMNS), "too_large").otherwise("ok")
    return c.withColumns({"status": status, "_row": F.coalesce("_row", F.lit(0)), "_col": F.coalesce("_col", F.lit(0))})


def laid_out_text(cells: DataFrame) -> DataFrame:
    """tbl, text of every table with status ok in laid_out(): each cell's text after the tabs and line ends between it and
    the cell before it, and those after the last."""
    c = _measured(cells).filter("status = 'ok'")
    tabs = lambda n: F.repeat(F.lit("\t"), n)
    full = tabs(F.col("_cols") - 1)  # the tabs of a whole row
    gap = F.when(F.col("row") == F.col("_row"), tabs(F.col("col") - F.col("_col"))).otherwise(F.concat(tabs(F.col("_cols") - 1 - F.col("_col")), F.repeat(F.concat(F.lit("\n"), full), F.col("row") - F.col("_row") - 1), F.lit("\n"), tabs(F.col("col"))))
    piece = F.struct("row", "col", F.concat(gap, F.coalesce("text", F.lit(""))).alias("piece"))
    out = c.groupBy("tbl").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"), F.first("_rows").alias("_rows"), F.first("_cols").alias("_cols"))
    last = F.element_at("_pieces", -1)
    rest = F.concat(tabs(F.col("_cols") - 1 - last["col"]), F.repeat(F.concat(F.lit("\n"), full), F.col("_rows") - 1 - last["row"]))
    return out.select("tbl", F.concat(F.array_join(F.transform("_pieces", lambda x: x["piece"]), ""), rest).alias("text"))


#: What a year header, a number, a unit, a foot note, a header word, an environmental and a financial label are.
YEAR = r"^(?:19|20)\d{2}(?:\s*년)?$"
NUMERIC = r"^[+−-]?\d+(?:[,.]\d+)*%?$"
UNIT = r"(?i)^(?:천|만)?(?:tCO[₂2](?:eq|e)?|MWh|GJ|TJ|kWh|톤|t|kg|m[³3]|㎥|%|MW|대)(?:/(?:백만원|천원|원|대|년|연|매출액|생산량))?$"
FOOTNOTE = r"^\s*(?:\d+[.)]|[※*])"
HEADER = r"^(?:지표명|구분|단위|항목|연도|지표)$"
ENVIRONMENT = r"(?i)온실가스|배출|에너지|전력|재생|폐기물|용수|취수|수자원|친환경|재활용|탄소|Scope|CO[₂2]|HEV|PHEV|EV|태양광|대기오염|수질오염|질소산화|황산화|COD|TOC|Dust"
FINANCIAL = r"자본변동표|자본잉여금|이익잉여금|지배기업 소유주지분|금융자산"
REGIONS = ("국내", "해외")
INTENSITY, POLLUTANT = "원단위", r"(?i)Dust|COD|TOC|NOx|SOx|VOCs|HAPs|SS|T-N|T-P"
HEAD_ROWS, MOST_OBSERVATIONS = 4, 24


def year_table(cells: DataFrame, *, most: int = MOST_OBSERVATIONS, environment: str = ENVIRONMENT, financial: str = FINANCIAL) -> DataFrame:
    """Observations of tables with a column for each year: tbl, row, start, end, value, unit, metric, year, comparisons
    (array of struct year, value, by column). cells: tbl, cell, row, col, row_span, col_span, text.

    Year headers stand in the first HEAD_ROWS rows, each year in one column and each column with one year; the labels
    before the first of them name something environmental and nothing financial. A row below counts if it has one unit, a
    label that is no header word or foot note, and a number in the latest year's column. Its metric is the path of labels:
    cells left of the years whose rows hold it (for a region or an intensity also the scope or pollutant last named above
    it), then header cells over the latest year that are no year; a label once. The first `most` rows of a table are kept."""
    c = sizing.staged(laid_out(cells).filter("status = 'ok'").withColumn("t", F.trim("text")), "grids")
    unsent = sizing.unsent
    y = c.filter((F.col("row") < HEAD_ROWS) & F.col("t").rlike(YEAR)).select("tbl", "row", "col", F.substring("t", 1, 4).alias("year"))
    by_column = y.groupBy("tbl", "col").agg(F.count_distinct("year").alias("_n"), F.min("year").alias("year"), F.max("row").alias("row"))
    heads = by_column.groupBy("tbl").agg(F.max("_n").alias("_n"), F.count("*").alias("_cols"), F.count_distinct("year").alias("_years"), F.max("row").alias("header_row"), F.min("col").alias("first"), F.max(F.struct("year", "col")).alias("latest"), F.array_sort(F.collect_list(F.struct("col", "year"))).alias("years"))
    heads = heads.filter("_n = 1 and _cols = _years").drop("_n", "_cols", "_years")
    labels = c.join(unsent(heads), "tbl").filter(F.col("col") < F.col("first")).groupBy("tbl").agg(F.bool_or(F.col("text").rlike(environment)).alias("env"), F.bool_or(F.col("text").rlike(financial)).alias("fin"))
    heads = heads.join(unsent(labels.filter("env and not fin").select("tbl")), "tbl", "left_semi")
    body = c.join(unsent(heads), "tbl")
    unit = F.regexp_replace("text", r"\s", "").rlike(UNIT)
    word = ~unit & ~F.col("t").rlike(HEADER) & (F.col("t") != "")
    stub = F.col("col") < F.col("first")
    rows = body.filter(F.col("row") > F.col("header_row")).groupBy("tbl", "row").agg(
        F.min("row_start").alias("start"), F.min("row_end").alias("end"), F.count_if(stub & unit).alias("_units"), F.max(F.when(stub & unit, F.col("text"))).alias("unit"),
        F.min(F.when(stub & ~unit & (F.col("t") != ""), F.struct("col", "t"))).alias("_label"), F.max(F.when(F.col("col") == F.col("latest.col"), F.col("t"))).alias("value"),
        F.map_from_entries(F.collect_list(F.when(~stub, F.struct("col", "text")))).alias("_texts"),
    )
    label = F.col("_label.t")
    rows = rows.filter((F.col("_units") == 1) & label.isNotNull() & ~label.rlike(FOOTNOTE) & ~label.rlike(HEADER) & F.col("value").rlike(NUMERIC) & ~F.col("value").rlike(YEAR))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("tbl").orderBy("row"))).filter(F.col("_nth") <= most)
    stubs = body.filter(stub & word).select("tbl", F.col("col").alias("_c"), F.col("start").alias("_s"), "text", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("row"))
    over = body.filter((F.col("row") <= F.col("header_row")) & ~F.col("t").rlike(YEAR) & word & (F.col("col") <= F.col("latest.col")) & (F.col("latest.col") < F.col("col") + F.col("col_span"))).groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("_over"))
    named = F.struct(F.col("col").alias("_c"), F.col("start").alias("_s"), "text", "t")
    last = F.last(F.when((F.col("row") >= 1) & (F.col("t") != "") & ~F.col("t").isin(*REGIONS), named), ignorenulls=True).over(Window.partitionBy("tbl", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    group = (F.col("t").isin(*REGIONS) & F.col("_last.t").contains("Scope")) | (F.col("t").startswith(INTENSITY) & F.col("_last.t").rlike(POLLUTANT))
    above = body.filter(stub).withColumn("_last", last).filter(group).select("tbl", "_last._c", "_last._s", "_last.text", "row")
    stubs = stubs.unionByName(above)
    path = rows.select("tbl", "row").join(unsent(stubs), ["tbl", "row"]).groupBy("tbl", "row").agg(F.array_sort(F.collect_list(F.struct("_c", "_s", "text"))).alias("_path"))
    out = rows.join(unsent(path), ["tbl", "row"], "left").join(unsent(over), "tbl", "left").join(unsent(heads.select("tbl", "years", "latest")), "tbl")
    none = F.array().cast("array<string>")
    metric = F.array_distinct(F.concat(F.coalesce(F.transform("_path", lambda x: x["text"]), none), F.coalesce(F.transform("_over", lambda x: x["text"]), none)))
    others = F.transform(F.filter("years", lambda x: x["col"] != F.col("latest.col")), lambda x: F.struct(x["year"].alias("year"), F.coalesce(F.col("_texts")[x["col"]], F.lit("")).alias("value")))
    return out.select("tbl", "row", "start", "end", "value", "unit", F.array_join(metric, " / ").alias("metric"), F.col("latest.year").alias("year"), others.alias("comparisons"))


def located(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Which table a cell is in, by what its parsers say. candidates: cell, parser, table_native, row, col, row_span, col_span
    (one row for each parser's copy of a cell); tables: parser, native, tbl (a table's names; null where a parser has none).
    Returns cell, tbl, row, col, row_span, col_span, issue: parse_conflict where copies name more than one place,
    table_layout_unresolved where the place is in no table or no proper one; places with an issue are null."""
    alias = tables.select("parser", F.col("native").alias("table_native"), "tbl").dropDuplicates(["parser", "table_native"])
    place = ("tbl", "row", "col", "row_span", "col_span")
    seen = candidates.join(alias, ["parser", "table_native"], "left").withColumn("row_span", F.coalesce("row_span", F.lit(1))).withColumn("col_span", F.coalesce("col_span", F.lit(1)))
    one = seen.groupBy("cell").agg(F.count_distinct(F.to_json(F.struct(*place))).alias("_n"), F.first(F.struct(*place)).alias("_at"))
    proper = F.col("_at.tbl").isNotNull() & (F.col("_at.row") >= 0) & (F.col("_at.col") >= 0) & F.col("_at.row_span").between(1, 1000) & F.col("_at.col_span").between(1, 1000)
    issue = F.when(F.col("_n") > 1, "parse_conflict").when(~F.coalesce(proper, F.lit(False)), "table_layout_unresolved")
    return one.select("cell", *[F.when(issue.isNull(), F.col(f"_at.{c}")).alias(c) for c in place], issue.alias("issue"))
