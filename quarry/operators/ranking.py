"""Orders, merges, tokens and history over results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.storage import cut_lineage

TokenProvider = Callable[[str, DataFrame], DataFrame | None]
#: Sort letters and their columns.
SORT_COLUMNS = {"s": "size", "c": "created", "m": "modified", "a": "accessed"}


def sort_token(token: str, rows: DataFrame) -> DataFrame | None:
    """'s', 's-' or '-s': a column to sort by, descending with '-'; equals stay in id order."""
    letter = token.strip("-")
    column = SORT_COLUMNS.get(letter)
    if column not in rows.columns or len(token) > 2:
        return None
    order = F.col(column).desc_nulls_last() if "-" in token else F.col(column).asc_nulls_last()
    return rows.orderBy(order, "id")


def extension_token(token: str, rows: DataFrame) -> DataFrame | None:
    """'.txt.doc': files of these extensions."""
    if not token.startswith(".") or len(token) < 2:
        return None
    return rows.where(F.lower(F.substring_index("name", ".", -1)).isin([x.lower() for x in token.split(".") if x]))


def segment_token(token: str, rows: DataFrame) -> DataFrame | None:
    """':x': rows of which a path segment matches."""
    from quarry.functions import predicates as P
    from quarry.functions import query as Q

    if not token.startswith(":") or len(token) < 2:
        return None
    return rows.where(F.exists(F.split("path", "/"), lambda s: P.pattern_column(s, Q.parse_pattern(token[1:]))))


PROVIDERS: list[TokenProvider] = [sort_token, extension_token, segment_token]


def apply_tokens(rows: DataFrame, tokens: tuple[str, ...], providers: list[TokenProvider] | None = None) -> DataFrame:
    """Tokens from left to right, the first provider that claims one wins; a token nobody claims empties the result."""
    for t in tokens:
        for p in providers or PROVIDERS:
            found = p(t, rows)
            if found is not None:
                rows = found
                break
        else:
            return rows.limit(0)
    return rows


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Adds the place of each row of a totally ordered DataFrame. The sort has dealt the rows by ranges, so a place is the
    number of rows in the ranges before, one row a range and joined as such, plus the place within. The ranges are
    checkpointed, else they could be drawn anew between counting and numbering."""
    at = F.col("_at")
    ranged = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))  # range << 33 | place within
    sizes = ranged.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    # there are as many ranges as partitions, whatever the data
    met = ranged.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(before), "_part", "left")
    return met.select(*rows.columns, (F.col("_first") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def numbered(rows: DataFrame, *order: Column | str, limit: int | None = None, name: str = "place") -> DataFrame:
    """Adds the place in the order; the window only sees as many rows as the limit, and without one there is no window."""
    if limit is None:
        return placed(rows.orderBy(*order), name)
    rows = rows.orderBy(*order).limit(limit)
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def first_of(rows: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The first row of each key in an ascending order that ends in a unique column; as an aggregate, so a hot key costs
    each task one row."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def merged(local: DataFrame, other: DataFrame, path_col: str = "path") -> DataFrame:
    """Local rows, and those of the other side whose path (case and separators aside) isn't among them."""
    norm = lambda c: F.lower(F.regexp_replace(F.translate(c, "\\", "/"), "(?<=.)/+$", ""))
    mine = local.select(norm(path_col).alias("_path")).distinct()
    return local.unionByName(other.withColumn("_path", norm(path_col)).join(mine, "_path", "left_anti").drop("_path"))


def curated_order(rows: DataFrame, path_col: str = "path") -> DataFrame:
    """One row of each path (case aside), the best by: curated first, priority, type, weight, short path, path."""
    return first_of(rows, F.lower(path_col), ~F.col("curated"), "priority", "type_rank", -F.col("weight"), F.length(path_col), path_col, "id")


def scoped(rows: DataFrame, folder: str, text: str, favorites: DataFrame, history: DataFrame) -> DataFrame:
    """Results of a search below one folder, which is no result itself. Rows that are favourites or in the history are
    curated; the rest of the order is that of curated_order(). Adds place.

    rows: id, path, name, weight, type_rank; favorites: path; history: path, last_at."""
    from quarry.functions import predicates as P
    from quarry.functions import query as Q

    root = folder.rstrip("/").lower()
    low = F.lower("path")
    found = rows.where(low.startswith(f"{root}/") & P.pattern_column(F.col("name"), Q.parse_pattern(text))).withColumn("_path", low)
    liked = favorites.select(F.lower("path").alias("_path")).distinct().withColumn("_liked", F.lit(True))
    used = history.groupBy(F.lower("path").alias("_path")).agg(F.max("last_at").alias("_at"))
    known = found.join(liked, "_path", "left").join(used, "_path", "left").drop("_path")
    marked = known.withColumns({"curated": F.col("_liked").isNotNull() | F.col("_at").isNotNull(), "priority": F.coalesce(-F.col("_at"), F.lit((1 << 63) - 1))}).drop("_liked", "_at")
    return numbered(curated_order(marked), ~F.col("curated"), "priority", "type_rank", -F.col("weight"), F.length("path"), "path", "id")


def keyword_list(rows: DataFrame, text: str, keyword: str, name_col: str, limit: int = 8) -> DataFrame:
    """A settings list behind its keyword: rows whose name fuzzily matches what follows it, the first few in catalog order
    (id); all of them where nothing follows, none where the text isn't for the keyword."""
    from quarry.functions import predicates as P
    from quarry.functions import query as Q

    rest = Q.keyword_gate(text, keyword)
    if rest is None:
        return rows.limit(0)
    return rows.where(P.pattern_column(F.col(name_col), Q.parse_pattern(rest))).orderBy("id").limit(limit) if rest else rows


def keyword_items(rows: DataFrame, text: str, keyword: str, own: Column) -> DataFrame:
    """Items behind a registered keyword, with their weight: all of its own at weight 1 for the bare keyword, else those that
    match what follows it by their match weight; none if the text isn't for the keyword."""
    from quarry.functions import predicates as P
    from quarry.functions import query as Q
    from quarry.functions import scoring as S

    rest = Q.keyword_gate(text, keyword)
    if rest is None:
        return rows.limit(0).withColumn("weight", F.lit(1.0))
    if not rest:
        return rows.where(own).withColumn("weight", F.lit(1.0))
    pattern = Q.parse_pattern(rest)
    return rows.where(own & P.pattern_column(F.col("name"), pattern)).withColumn("weight", S.weight_udf(pattern)("name"))


def result_columns(rows: DataFrame) -> DataFrame:
    """What a result shows: id, name, path, is_dir, kind (D or F), drive (a letter before a colon, null elsewhere), modified."""
    drive = F.nullif(F.upper(F.regexp_extract("path", "^([A-Za-z]):", 1)), F.lit(""))
    return rows.select("id", "name", "path", "is_dir", F.when(F.col("is_dir"), "D").otherwise("F").alias("kind"), drive.alias("drive"), "modified")


def shown_path(path: Column, mounts: dict[str, str]) -> Column:
    """A path as a mount shows it: the longest mounted directory that holds it is replaced; others stay as they are."""
    out = path
    for directory, shown in sorted(mounts.items(), key=lambda kv: len(kv[0])):
        at = directory.rstrip("/")
        inside = (F.lower(path) == at.lower()) | F.lower(path).startswith(f"{at.lower()}/")
        out = F.when(inside, F.concat(F.lit(shown.rstrip("/")), F.substring(path, len(at) + 1, 1 << 30))).otherwise(out)
    return out


def relative_parent(path: Column, base: str) -> Column:
    """The directory of a path as seen from a base: what follows the base, '' in the base itself, the whole of it elsewhere."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    at = base.rstrip("/")
    inside = F.lower(parent).startswith(f"{at.lower()}/")
    return F.when(F.lower(parent) == at.lower(), F.lit("")).when(inside, F.substring(parent, len(at) + 2, 1 << 30)).otherwise(parent)
