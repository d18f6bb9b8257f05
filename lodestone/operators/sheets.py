"""Regions of sheets: what stands together between blank rows, whether it has a header, how its columns are called, and what makes it no table.

Cells are rows: sheet, row_number, column_number (both from 1) and cell (shown text); merged ranges: sheet, r1, c1, r2, c2. All is told by windows and aggregates over a sheet's rows; a row of
a region is one array, so nothing but a sheet's width is held at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.structure import stripped

#: What a number is, what the last word of a header is often, labels of summary rows, and lengths of header cells (fixed values).
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"
HINTS = r"(?i)(?:编号|序号|代码|名称|姓名|日期|时间|金额|数量|单价|合计|状态|类型|部门|地区|城市|客户|供应商|备注|说明|地址|电话|邮箱|id|name|date|time|amount|price|count|status|type|total|description)$"
SUMMARIES = ["合计", "总计", "小计", "subtotal", "grand total", "total"]
LONGEST, SHORT = 40, 24


def letters(number: Column) -> Column:
    """A column's letters; number from 1, three letters at most."""
    digit = lambda n: F.chr(F.lit(65) + n.cast("int"))
    two, three = number - 27, number - 703
    return (
        F.when(number <= 26, digit(number - 1)).when(number <= 702, F.concat(digit(F.floor(two / 26)), digit(two % 26)))
        .otherwise(F.concat(digit(F.floor(three / 676)), digit(F.floor(three / 26) % 26), digit(three % 26)))
    )


def region_rows(cells: DataFrame) -> DataFrame:
    """A row a row of a sheet that has a cell: sheet, row_number, cells (column, cell) in order, region (from 1) and n, its place in the region (from 1)."""
    filled = cells.select("sheet", "row_number", "column_number", stripped(F.col("cell")).alias("cell")).where("cell <> ''")
    rows = filled.groupBy("sheet", "row_number").agg(F.array_sort(F.collect_list(F.struct(F.col("column_number").alias("column"), "cell"))).alias("cells"))
    order = Window.partitionBy("sheet").orderBy("row_number")
    new = F.coalesce(F.col("row_number") > F.lag("row_number").over(order) + 1, F.lit(True))
    rows = rows.withColumn("new", new).withColumn("region", F.count_if("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("sheet", "region").orderBy("row_number")))


def _is_header(first: Column, second: Column) -> Column:
    """Whether a first row is one: two different cells at least, none a number, long or a formula; and one has a header's word, or the second row has a number and all are short."""
    texts = F.transform(first, lambda x: x["cell"])
    numbers = lambda of: F.exists(of, lambda x: x["cell"].rlike(NUMBER))
    sane = (F.size(texts) >= 2) & (F.size(F.array_distinct(texts)) == F.size(texts)) & ~F.exists(texts, lambda t: (F.length(t) > LONGEST) | t.startswith("=")) & ~numbers(first)
    hinted = F.exists(texts, lambda t: t.rlike(HINTS)) | (numbers(second) & F.forall(texts, lambda t: F.length(t) <= SHORT))
    return F.coalesce(second.isNotNull() & sane & hinted, F.lit(False))


def _names(first: Column, width: Column, headed: Column) -> Column:
    """Names of columns 1 to width: the header's, else the column's letters; one that was given before gets a number."""
    columns = F.sequence(F.lit(1), width.cast("int"))
    at = lambda c: F.get(F.filter(first, lambda x: x["column"] == c), F.lit(0))["cell"]
    own = F.transform(columns, lambda c: F.coalesce(F.when(headed, at(c)), F.concat(letters(c), F.lit("列"))))
    return F.get(F.transform(F.array(own), lambda names: F.transform(names, lambda x, i: F.concat(x, F.transform(F.array(F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x))), lambda k: F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""))[0]))), F.lit(0))


def regions(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """A row a region of ``region_rows``: sheet, region, row_start, row_end, n_rows, header_row, columns (names), risks and eligible. A region with a risk is no table: it has no header, and its
    columns are called by their letters."""
    size = F.size("cells")
    label = F.lower(F.get("cells", F.lit(0))["cell"])
    r = rows.groupBy("sheet", "region").agg(
        F.min("row_number").alias("row_start"), F.max("row_number").alias("row_end"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("cells", lambda x: x["column"]))))).alias("used"),
        F.bool_or(size == 1).alias("single"), F.bool_or((F.col("n") > 1) & label.isin(SUMMARIES)).alias("summary"), F.max(F.when(F.col("n") == 1, F.col("cells"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("cells"))).alias("second"),
    )
    least, most = F.array_min("used"), F.array_max("used")
    m = merges.withColumnRenamed("sheet", "of")
    meets = (F.col("sheet") == F.col("of")) & (F.col("r1") <= F.col("row_end")) & (F.col("r2") >= F.col("row_start")) & (F.col("c1") <= most) & (F.col("c2") >= least) & ((F.col("r1") < F.col("r2")) | (F.col("c1") < F.col("c2")))
    merged = r.join(m, meets, "left_semi").select("sheet", "region", F.lit(True).alias("merged"))
    r = r.join(merged, ["sheet", "region"], "left").withColumn("headed", _is_header(F.col("first"), F.col("second")))
    risk = lambda when, name: F.when(when, F.lit(name))
    risks = F.array_compact(F.array(
        risk(F.col("merged"), "merged_cells"), risk(F.size("used") < most - least + 1, "separated_columns"), risk((F.size("used") > 1) & F.col("single"), "mixed_single_cell_rows"),
        risk(F.col("summary"), "summary_rows"), risk(~F.col("headed"), "unconfirmed_header"),
    ))
    r = r.withColumn("risks", risks).withColumn("eligible", F.size("risks") == 0)
    return r.select("sheet", "region", "row_start", "row_end", "n_rows", F.when(F.col("eligible"), F.col("row_start")).alias("header_row"), _names(F.col("first"), most, F.col("eligible")).alias("columns"), "risks", "eligible")


def row_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """sheet, region, row_number and line of each row that is no header: its number, and its cells under their columns' names."""
    own = rows.join(found.select("sheet", "region", "header_row", "columns"), ["sheet", "region"]).where(~F.col("row_number").eqNullSafe(F.col("header_row")))
    said = F.transform("cells", lambda x: F.concat(F.get("columns", x["column"] - 1), F.lit("="), F.when(x["cell"].startswith("="), "公式").otherwise(""), x["cell"]))
    return own.select("sheet", "region", "row_number", F.concat(F.lit("行 "), F.col("row_number").cast("string"), F.lit("｜"), F.array_join(said, "｜")).alias("line"))
