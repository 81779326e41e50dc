"""Queries of term predicates, scores and name search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import predicates as P
from quarry.functions import query as Q
from quarry.functions import scoring as S
from quarry.operators import search as N
from quarry.operators.storage import Snapshots
from quarry.plans.registry import query
from quarry.sources import catalog


def _matching(text: str, fuzzy: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalog.parts(spark, sf_dir)
        return N.fan_out(N.matching_names(rows, Q.parse_pattern(text, fuzzy)), rows).select("id", "name")

    return run


#: key -> (query text, DuckDB predicate over name)
_PREDICATES = {
    "match_fuzzy": ("blb", "lower(name) LIKE '%b%l%b%'"),
    "match_exact": ("'bolt", "contains(lower(name), 'bolt')"),
    "match_boundary": ("'ring'", "regexp_matches(lower(name), '(^|[^a-z0-9])ring([^a-z0-9]|$)')"),
    "match_prefix": ("^blue", "starts_with(ltrim(lower(name)), 'blue')"),
    "match_suffix": ("economy$", "ends_with(rtrim(lower(name)), 'economy')"),
    "match_equal": ("^red\\ widget.economy$", "lower(trim(name)) = 'red widget.economy'"),
    "match_inverse": ("!ring", "NOT contains(lower(name), 'ring')"),
    "match_and": ("small rng .eco", "lower(name) LIKE '%s%m%a%l%l%' AND lower(name) LIKE '%r%n%g%' AND lower(name) LIKE '%.%e%c%o%'"),
    "match_or": ("^red | ring$ | 'bolt", "starts_with(ltrim(lower(name)), 'red') OR ends_with(rtrim(lower(name)), 'ring') OR contains(lower(name), 'bolt')"),
    "match_smartcase": ("'Red | 'bolt", "contains(name, 'Red') OR contains(lower(name), 'bolt')"),
}
for _key, (_text, _sql) in _PREDICATES.items():
    query(f"SELECT id, name FROM parts WHERE {_sql}", _key)(_matching(_text))
query("SELECT id, name FROM parts WHERE contains(lower(name), 'bolt') AND lower(name) LIKE '%b%u%e%'", "match_fuzzy_off")(_matching("bolt 'bue", False))


@query()
def match_fuzzy_long(spark, sf_dir):
    """Whole documents with the alignment of the term; beyond scoring.MAX_CELLS the greedy scan scores them. The match set
    is the same whichever scan scores them."""
    term = "entrale"
    texts = catalog.table(spark, sf_dir, "documents").where(P.pattern_column(F.col("text"), Q.parse_pattern(term)))
    scored = texts.select(F.col("doc_id").alias("id"), S.fuzzy_udf(term)("text").alias("m")).where("m.score is not null")
    return scored.select("id", F.lit(True).alias("hit"), "m.*")


@query("SELECT p_partkey AS id, list_bool_or(list_transform([lower(p_name), lower(p_brand), lower(p_type)], lambda s: contains(s, 'bolt') AND contains(s, 'bl'))) AS hit FROM part")
def match_segmented(spark, sf_dir):
    """A text of several segments matches if one of them does; the terms don't straddle segments."""
    rows = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("text"))
    return rows.select("id", P.segmented_column(F.col("text"), Q.parse_pattern("'bolt 'bl")).alias("hit"))


_BITS = "list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(list_distinct(string_split(lower(name), '')), lambda c: CAST(1 AS UBIGINT) << CAST(CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 97 WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 22 ELSE 36 + ascii(c) % 28 END AS UBIGINT))), lambda a, b: a | b)"


@query(f"SELECT DISTINCT name, printf('%016X', {_BITS}) AS mask FROM parts")
def prefilter_charmask(spark, sf_dir):
    return N.names_of(catalog.parts(spark, sf_dir)).select("name", F.lpad(F.hex("mask"), 16, "0").alias("mask"))


@query("SELECT id, name, lower(name) LIKE '%b%o%' AS hit FROM parts")
def fn_is_match(spark, sf_dir):
    """The one-shot matcher as a column function."""
    return catalog.parts(spark, sf_dir).select("id", "name", P.pattern_column(F.col("name"), Q.parse_pattern("bo")).alias("hit"))


@query()
def score_fuzzy(spark, sf_dir):
    return N.scored_names(catalog.parts(spark, sf_dir), Q.parse_pattern("smrg"))


@query()
def score_exact(spark, sf_dir):
    return N.scored_names(catalog.parts(spark, sf_dir), Q.parse_pattern("'ring"))


_START = "instr(lower(name), 'ring')"
_BONUS = f"CASE WHEN {_START} = 1 OR substr(name, {_START} - 1, 1) = ' ' THEN 10 WHEN substr(name, {_START} - 1, 1) IN ('/', ':', ';', ',', '|') THEN 9 ELSE 8 END"


def _scored(spark, sf_dir, text: str) -> DataFrame:
    return N.scored_names(catalog.parts(spark, sf_dir), Q.parse_pattern(text))


@query(f"SELECT DISTINCT name, 16 * 4 + 10 * 5 + {_BONUS} AS score FROM parts WHERE regexp_matches(lower(name), '(^|[^a-z0-9])ring([^a-z0-9]|$)')")
def score_boundary(spark, sf_dir):
    return _scored(spark, sf_dir, "'ring'").select("name", "score")


@query("SELECT DISTINCT name, CAST(26 * length(trim(name)) + 10 AS INTEGER) AS score FROM parts WHERE lower(trim(name)) = 'red widget.economy'")
def score_equal(spark, sf_dir):
    return _scored(spark, sf_dir, "^red\\ widget.economy$").select("name", "score")


# a literal term at a word start: 16 a character, the bonus of the start carried through the run and doubled on the first
_KEYS = """SELECT DISTINCT name, -(16 * 4 + b * 5) AS k_score, CAST(length(trim(name)) AS INTEGER) AS k_length, 4 AS k_span, CAST(CASE WHEN p = 1 THEN 0 ELSE 256 + p - 1 END AS INTEGER) AS k_position
FROM (SELECT name, instr(lower(name), 'bolt') AS p, CASE WHEN instr(lower(name), 'bolt') = 1 OR substr(name, instr(lower(name), 'bolt') - 1, 1) = ' ' THEN 10 ELSE 8 END AS b FROM parts) WHERE p > 0"""


@query(_KEYS)
def rank_key(spark, sf_dir):
    """All four rank fields of a literal term."""
    return _scored(spark, sf_dir, "'bolt").select("name", *N.KEY)


@query(f"""WITH k AS ({_KEYS}) SELECT CAST(row_number() OVER (ORDER BY k_score, k_length, k_span, k_position, id) AS INTEGER) AS place, id, name FROM parts JOIN k USING (name)
 ORDER BY k_score, k_length, k_span, k_position, id LIMIT 25""")
def topk_rank(spark, sf_dir):
    """Top k by key then id; the window only numbers the k rows."""
    best = N.top_rows(catalog.parts(spark, sf_dir), Q.parse_pattern("'bolt"), 25)
    return best.select(F.row_number().over(Window.orderBy(*N.KEY, "id")).alias("place"), "id", "name")


_BOTH = """SELECT id, name, 16 * 4 + (CASE WHEN p = 1 OR substr(name, p - 1, 1) = ' ' THEN 10 ELSE 8 END) * 5 + 16 * 4 + 10 * 5 AS score, CAST(length(trim(name)) AS INTEGER) AS k_length, CAST(p + 3 AS INTEGER) AS k_span, 0 AS k_position,
 length(name) AS n FROM (SELECT id, name, instr(lower(name), 'bolt') AS p FROM parts WHERE contains(lower(name), 'bolt') AND starts_with(lower(name), 'blue'))"""


@query(f"SELECT id, name, -score AS k_score, k_length, k_span, k_position FROM ({_BOTH}) ORDER BY k_score, k_length, k_span, k_position, id LIMIT 20")
def search_name_exact(spark, sf_dir):
    """Minimum slice: "'bolt ^blue" end to end, without the second stage."""
    return N.top(N.fan_out(_scored(spark, sf_dir, "'bolt ^blue"), catalog.parts(spark, sf_dir)), 20).select("id", "name", *N.KEY)


_WEIGHTED = f"""WITH x AS ({_BOTH}), first AS (SELECT * FROM x ORDER BY -score, k_length, k_span, k_position, id LIMIT 160)
SELECT id, name, score, CAST(-floor(score * (8.0 / n * (32.0 / 64))) AS INTEGER) AS k_score, k_length, k_span, k_position FROM first ORDER BY k_score, k_length, k_span, k_position, id LIMIT 20"""


@query(_WEIGHTED)
def search_name_weighted(spark, sf_dir):
    """Both stages of a search: two words of four characters that stand apart weigh 8 / length times 32 / 64."""
    return N.search(catalog.parts(spark, sf_dir), "'bolt ^blue", 20).select("id", "name", "score", *N.KEY)


@query(_WEIGHTED)
def search_name_stored(spark, sf_dir):
    """The same search over a stored snapshot, whose name dictionary spares the distinct over all rows."""
    store = Snapshots(spark)
    version = store.write(catalog.parts(spark, sf_dir).select("id", "name", "source_key"), dictionary=N.names_of)
    return N.search(store.read(version), "'bolt ^blue", 20, dictionary=store.dictionary(version)).select("id", "name", "score", *N.KEY)


@query()
def search_name(spark, sf_dir):
    return N.search(catalog.parts(spark, sf_dir), "smrg !plate", 20).select("id", "name", "begin", "end", "score", *N.KEY)


@query()
def highlight_ranges(spark, sf_dir):
    pattern = Q.parse_pattern("sml 'ring")
    return N.matching_names(catalog.parts(spark, sf_dir), pattern).select("name", S.ranges_udf(pattern)("name").alias("ranges"))


@query("SELECT DISTINCT name, round(4.0 / length(name), 9) AS weight FROM parts WHERE contains(lower(name), 'ring') AND instr(lower(name), 'ring') = length(name) - instr(reverse(lower(name)), 'gnir') - 2")
def match_weight(spark, sf_dir):
    """Weight of a single literal run: its share of the name."""
    pattern = Q.parse_pattern("'ring")
    once = F.regexp_count(F.lower("name"), F.lit("ring")) == 1
    return N.matching_names(catalog.parts(spark, sf_dir), pattern).where(once).select("name", F.round(S.weight_udf(pattern)("name"), 9).alias("weight"))


@query("SELECT id, name FROM parts WHERE contains(lower(name), 'bolt')")
def join_name_fanout(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir)
    return N.fan_out(N.matching_names(rows, Q.parse_pattern("'bolt")), rows).select("id", "name")


# initials and full spelling of part names stand in for transliterations
def _aliases(spark, sf_dir):
    names = catalog.parts(spark, sf_dir).select("name").distinct()
    initials = F.concat(F.substring("name", 1, 1), F.expr("substr(name, instr(name, ' ') + 1, 1)"))
    return names.select("name", F.lit(1).alias("provider_id"), initials.alias("alias")).unionByName(names.select("name", F.lit(2).alias("provider_id"), F.regexp_replace("name", " ", "").alias("alias")))


@query()
def match_alias(spark, sf_dir):
    """Aliases count only where the literal name fails; of the accepted ones the best weighted wins."""
    from quarry.functions.alias import best_alias

    pattern = Q.parse_pattern("srng")
    names = catalog.parts(spark, sf_dir).select("name").distinct()
    direct = names.withColumn("m", S.match_udf(Q.parse_pattern("'srng"))("name"))
    found = best_alias(direct.where("m.score is null").select("name").join(_aliases(spark, sf_dir), "name"), pattern)
    return direct.join(found, "name", "left").select("name", F.coalesce("m.score", "alias_score").alias("score"), F.col("m.score").isNull().alias("by_alias")).where("score is not null")


@query("""SELECT q, span, score, span <= greatest(3 * q, 20) AND score >= 5 * q AS accepted FROM (SELECT (id % 9) + 1 AS q, id % 37 AS span, id % 53 AS score FROM parts)""")
def alias_gate(spark, sf_dir):
    from quarry.functions.alias import acceptable

    rows = catalog.parts(spark, sf_dir).select((F.col("id") % 9 + 1).alias("q"), (F.col("id") % 37).alias("span"), (F.col("id") % 53).alias("score"))
    return rows.withColumn("accepted", acceptable(F.col("span"), F.col("score"), F.col("q")))


@query("SELECT id, CASE WHEN s > l THEN CAST(round_even(c * l / s, 0) AS BIGINT) ELSE c END AS w FROM (SELECT id, CAST(id % 6 + 1 AS DOUBLE) AS l, CAST(id % 17 + 1 AS DOUBLE) AS s, id % 101 AS c FROM parts)")
def alias_weight(spark, sf_dir):
    from quarry.functions.alias import alias_score

    rows = catalog.parts(spark, sf_dir).select("id", (F.col("id") % 6 + 1).alias("l"), (F.col("id") % 17 + 1).alias("s"), (F.col("id") % 101).alias("c"))
    return rows.select("id", alias_score(F.col("c"), F.col("l"), F.col("s")).alias("w"))


@query("SELECT DISTINCT name, ext, folder, round(greatest(CASE WHEN contains(lower(name), 'ing') THEN 3.0 / length(name) ELSE 0 END, CASE WHEN contains(lower(ext), 'ing') THEN 3.0 / length(ext) ELSE 0 END, CASE WHEN contains(lower(folder), 'ing') THEN 3.0 / length(folder) ELSE 0 END), 9) AS best FROM parts")
def best_of_texts(spark, sf_dir):
    """Best weight over a title and its other texts."""
    rows = catalog.parts(spark, sf_dir).select("name", "ext", "folder").distinct()
    return rows.select("*", F.round(S.best_weight_udf(Q.parse_pattern("'ing"))("name", "ext", "folder"), 9).alias("best"))


@query("""SELECT id, CASE WHEN contains(lower(name), 'srng') THEN 'name' WHEN contains(lower(replace(name, ' ', '')), 'dbol') THEN 'form' END AS by FROM parts WHERE contains(lower(name), 'srng') OR contains(lower(replace(name, ' ', '')), 'dbol')""")
def match_alias_forms(spark, sf_dir):
    """A provider's alternative spellings of a term join its set of alternatives, after the term itself."""
    pattern = Q.parse_pattern("'srng", alias_forms=lambda text: ["dbol"] if text == "srng" else [])
    rows = catalog.parts(spark, sf_dir).withColumn("joined", F.replace("name", F.lit(" "), F.lit("")))
    plain = Q.parse_pattern("'srng")
    return rows.where(P.pattern_column(F.col("joined"), pattern) | P.pattern_column(F.col("name"), plain)).select("id", F.when(P.pattern_column(F.col("name"), plain), "name").otherwise("form").alias("by"))


@query("SELECT name, provider_id, CAST(CASE provider_id WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS version, CASE provider_id WHEN 1 THEN substr(name, 1, 1) || substr(name, instr(name, ' ') + 1, 1) ELSE replace(name, ' ', '') END AS alias FROM (SELECT DISTINCT name FROM parts) CROSS JOIN (VALUES (1), (2)) AS p(provider_id)")
def alias_reconcile(spark, sf_dir):
    """Stored aliases of an older provider version, of a provider that is gone and of names that are gone are replaced."""
    from quarry.functions import alias as A

    names = catalog.parts(spark, sf_dir).select("name")
    initials = A.AliasProvider(1, 2, lambda n: [n[:1] + n[n.find(" ") + 1 : n.find(" ") + 2]])
    joined = A.AliasProvider(2, 1, lambda n: [n.replace(" ", "")])
    old = names.distinct().select("name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("provider_id"), F.lit(1).alias("version"), F.when(F.col("provider_id") == 2, F.replace("name", F.lit(" "), F.lit(""))).otherwise(F.reverse("name")).alias("alias"))
    old = old.where("name not like 'red%' or provider_id <> 2").unionByName(spark.createDataFrame([("gone", 2, 1, "gone")], old.schema))
    return A.reconcile(old, names, [initials, joined])


@query("SELECT p_partkey AS id, [0, NULL, 0, NULL][p_size % 4 + 1] AS begin, [2, NULL, 2, NULL][p_size % 4 + 1] AS \"end\", CAST(80 AS INTEGER) AS score FROM part WHERE p_size % 4 = 0")
def match_mixed(spark, sf_dir):
    """Terms that mix source letters and alias spelling: of these names only the first has both, one behind the other."""
    from quarry.functions.alias import mixed_match_udf

    names = F.array(*(F.lit(n) for n in ("重庆火锅", "北京烤鸭", "庆重", "plain")))
    rows = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_size") % 4 + 1).cast("int")).alias("name"))
    found = rows.select("name").distinct().withColumn("m", mixed_match_udf("重qing")("name")).where("m.score is not null")
    return rows.join(found, "name").select("id", "m.begin", "m.end", "m.score")


@query("""SELECT DISTINCT name, scheme, CAST(64 + 5 * CASE WHEN p = 1 THEN at_start ELSE 8 END AS INTEGER) AS score FROM (SELECT name, instr(lower(name), 'bolt') AS p FROM parts) CROSS JOIN (VALUES ('path', 9), ('history', 8)) AS s(scheme, at_start) WHERE p > 0""")
def score_schemes(spark, sf_dir):
    """A literal at a word start under the other schemes: a path begins behind a delimiter, and white space counts as any boundary."""
    rows = catalog.parts(spark, sf_dir)
    each = [N.scored_names(rows, Q.parse_pattern("'bolt"), scheme).select("name", F.lit(scheme).alias("scheme"), "score") for scheme in ("path", "history")]
    return each[0].unionByName(each[1])


@query("""SELECT id, name, round(2.0 / length(name), 9) AS weight FROM (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'My nation ' || n_nationkey WHEN 1 THEN 'https://fav.example/' || n_name ELSE n_name END AS name FROM nation)
 WHERE contains(lower(name), 'na') AND length(name) - length(replace(lower(name), 'na', '')) = 2""")
def match_favorites(spark, sf_dir):
    """Display name: custom name, else url, else leaf name; with its match weight."""
    key = F.col("n_nationkey")
    favorites = catalog.table(spark, sf_dir, "nation").select(key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("My nation "), key.cast("string"))).alias("custom"), F.when(key % 3 == 1, F.concat(F.lit("https://fav.example/"), "n_name")).alias("url"), F.concat(F.lit("T:/"), "n_name").alias("path"))
    found = N.favorites(favorites, Q.parse_pattern("'na"))
    return found.where(F.regexp_count(F.lower("name"), F.lit("na")) == 1).select("id", "name", F.round("weight", 9).alias("weight"))


# ---- providers
def _extensions():
    from quarry.functions.extensions import Extensions

    return Extensions(
        items=[
            lambda spark, sf_dir: catalog.parts(spark, sf_dir).where("name like 'red%'").select("name", "path", F.lit(1.0).alias("weight")).distinct(),
            lambda spark, sf_dir: catalog.page_paths(spark, sf_dir).select("name", "path").distinct(),
        ],
        columns={"initial": lambda: F.upper(F.substring("name", 1, 1)), "length": lambda: F.length("name").cast("string")},
        filters={"bolts": F.col("name").contains("bolt"), "large": F.col("size") > 50 * 1048576, "small": F.col("size") < 1048576},
    )


@query("SELECT DISTINCT name, path, CAST(1.0 AS DOUBLE) AS weight FROM parts WHERE starts_with(name, 'red') UNION ALL SELECT DISTINCT name, path, CAST(NULL AS DOUBLE) FROM page_paths")
def ext_items(spark, sf_dir):
    """Rows of all item providers: one weighs its items, the other doesn't."""
    return _extensions().catalog(spark, sf_dir)


@query("SELECT id, upper(substr(name, 1, 1)) AS initial, CAST(length(name) AS VARCHAR) AS length FROM parts")
def ext_columns(spark, sf_dir):
    return _extensions().with_columns(catalog.parts(spark, sf_dir)).select("id", "initial", "length")


@query("SELECT id FROM parts WHERE contains(name, 'bolt') AND (size > 50 * 1048576 OR size < 1048576)")
def ext_filters(spark, sf_dir):
    """Sidebar filters of providers: alternatives within a group, all groups together."""
    return _extensions().filtered(catalog.parts(spark, sf_dir), [["bolts"], ["large", "small"]]).select("id")


@query("SELECT page_id, CASE WHEN substr(url, 1, 1) = 'h' THEN 'web' ELSE 'other' END AS kind, CASE WHEN substr(url, 1, 1) = 'h' THEN ltrim(substr(url, 2)) ELSE url END AS rest FROM pages WHERE url IS NOT NULL")
def type_triggers(spark, sf_dir):
    """The first character picks a result type and is taken off, as a column."""
    rows = catalog.table(spark, sf_dir, "pages").where("url is not null")
    kind, rest = Q.trigger_columns(F.col("url"), {"h": "web"})
    return rows.select("page_id", F.coalesce(kind, F.lit("other")).alias("kind"), rest.alias("rest"))
