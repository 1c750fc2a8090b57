"""Queries of problems 4 to 8, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.mixing import mix, mixing_rates, mixing_report
from touchline.llm.packing import combine_texts, containers, pack_documents, packing_report, text_key
from touchline.llm.runs import collapse_runs
from touchline.llm.tokens import token_count, token_sizes
from touchline.llm.topn import latest_of_key, top_n
from touchline.llm.visual import look_alike_classes, look_alike_links, look_alike_pairs
from touchline.plans.problems import kept_fixtures
from touchline.session import materialise, read_table

_KEY = ["league_season_id", "event_name", "context", "team_id"]


def _best(spark: SparkSession, root: str) -> DataFrame:
    form = read_table(spark, root, "team_form")
    latest = latest_of_key(form, _KEY, "updated_at", ["score", "streak_length"])
    fit = latest.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.desc("score"), F.desc_nulls_last("streak_length"), F.asc("team_id"), F.asc("event_name"), F.asc("context")]
    return top_n(fit, "league_season_id", "score", order, 10, "rank", counts_of=form)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _best(spark, root).select("league_season_id", "team_id", "event_name", "context")


def p4_ranked(spark: SparkSession, root: str) -> DataFrame:
    return _best(spark, root).select(*_KEY, "score", "streak_length", F.col("rank").cast("int").alias("rank"))


def meaning(result):
    """win, draw or loss for any spelling of them, else null."""
    word = F.lower(F.regexp_replace(result, "[^A-Za-z]", ""))
    return (
        F.when(word.isin("w", "win", "won", "wins", "victory"), "win")
        .when(word.isin("d", "draw", "drawn", "drew", "tie", "tied"), "draw")
        .when(word.isin("l", "loss", "lost", "lose", "defeat"), "loss")
    )


def _series(spark: SparkSession, root: str, least: int = 2) -> DataFrame:
    columns = ["home_team_id", "kickoff_utc", "api_fixture_id", "home_fulltime_result"]
    kept = kept_fixtures(spark, root, columns).withColumn("result", meaning(F.col("home_fulltime_result")))
    sizes = read_table(spark, root, "raw_fixtures").select("home_team_id", "kickoff_utc")
    return collapse_runs(kept, "home_team_id", "kickoff_utc", "api_fixture_id", "result", least, sizes_of=sizes)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = _series(spark, root)
    return found.select("home_team_id", F.col("first_id").alias("first_api_fixture_id"), F.col("n_events").cast("int").alias("n_events"))


def p5_series(spark: SparkSession, root: str, least: int = 2) -> DataFrame:
    return _series(spark, root, least).select(
        "home_team_id",
        F.col("event").alias("result"),
        F.col("first_id").alias("first_api_fixture_id"),
        F.col("last_id").alias("last_api_fixture_id"),
        F.unix_seconds("first_at").alias("first_s"),
        F.unix_seconds("last_at").alias("last_s"),
        F.col("n_events").cast("int").alias("n_events"),
        F.col("duration_s").cast("long").alias("duration_s"),
    )


def p5_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """Whole sequences collapsed: series of one are in it too."""
    return p5_series(spark, root, 1)


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    documents = read_table(spark, root, "documents")
    return materialise(documents.select("doc_id", "source", token_count("text").alias("n_tokens")), "sizes")


def _packed(spark: SparkSession, root: str, key: str | None = None) -> DataFrame:
    limits = [(r["profile"], r["capacity_tokens"]) for r in read_table(spark, root, "pack_limits").select("profile", "capacity_tokens").collect()]
    documents = read_table(spark, root, "documents")
    keys = [text_key("text").alias(key)] if key else []
    sizes = materialise(documents.select("doc_id", *keys, token_sizes("text").alias("s")).select("*", "s.*").drop("s"), "sizes")
    return pack_documents(sizes, "doc_id", "n_tokens", limits, inside="inside", key=key)


def p6_pack(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root)


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return containers(_packed(spark, root), "doc_id")


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    packed = materialise(_packed(spark, root, "text_key"), "packed")
    return combine_texts(packed, read_table(spark, root, "documents"), "doc_id", "text", key="text_key")


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(_packed(spark, root))


def p6_balance(spark: SparkSession, root: str) -> DataFrame:
    """Documents packed by their characters, of which SQL knows the numbers: what went in, and what may not come out.

    For each profile the documents, pieces and characters packed, the containers that exceed their
    capacity, and the documents divided although they fit.
    """
    limits = [(r["profile"], r["capacity_tokens"]) for r in read_table(spark, root, "pack_limits").select("profile", "capacity_tokens").collect()]
    sizes = read_table(spark, root, "documents").select("doc_id", "n_chars")
    packed = materialise(pack_documents(sizes, "doc_id", "n_chars", limits, between=0), "packed")
    keys = ["profile", "capacity"]
    held = packed.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"))
    docs = packed.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("p"), F.sum("n_tokens").alias("n"))
    totals = docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("p").alias("n_pieces"),
        F.sum("n").alias("n_size"),
        F.count_if((F.col("p") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_divided_that_fit"),
    )
    return totals.join(held, keys)


def p7_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rates of a mixture by characters, of which SQL knows the numbers, and the documents used neither floor(rate) times nor once more."""
    sizes = read_table(spark, root, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    rates = mixing_rates(sizes, read_table(spark, root, "mix_targets"))
    least = F.floor("rate")
    uses = mix(sizes, rates, "doc_id").groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("c")).join(rates.select("source", "rate"), "source")
    judged = uses.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.count_if((F.col("c") < least) | (F.col("c") > least + 1)).alias("bad"))
    unused = F.when(least >= 1, F.col("n_docs") - F.coalesce("used", F.lit(0))).otherwise(0)
    return rates.join(judged, "source", "left").withColumn("n_outside", F.coalesce("bad", F.lit(0)) + unused).drop("used", "bad")


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    sizes = _sizes(spark, root)
    return mix(sizes, mixing_rates(sizes, read_table(spark, root, "mix_targets")), "doc_id")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    sizes = _sizes(spark, root)
    rates = mixing_rates(sizes, read_table(spark, root, "mix_targets"))
    return mixing_report(mix(sizes, rates, "doc_id"), rates)


def p7_capped(spark: SparkSession, root: str) -> DataFrame:
    """A mixture as large as all documents together, for which scarce sources reach their cap and fall short."""
    sizes = _sizes(spark, root)
    total = sizes.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    rates = mixing_rates(sizes, read_table(spark, root, "mix_targets"), total)
    return mixing_report(mix(sizes, rates, "doc_id"), rates)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return look_alike_pairs(read_table(spark, root, "documents"), "doc_id", "text")


def p8_links(spark: SparkSession, root: str) -> DataFrame:
    return look_alike_links(read_table(spark, root, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, root: str) -> DataFrame:
    return look_alike_classes(read_table(spark, root, "documents"), "doc_id", "text")


QUERIES = {
    "p4_found": p4_found,
    "p4_ranked": p4_ranked,
    "p5_found": p5_found,
    "p5_series": p5_series,
    "p5_collapsed": p5_collapsed,
    "p6_pack": p6_pack,
    "p6_containers": p6_containers,
    "p6_texts": p6_texts,
    "p6_report": p6_report,
    "p6_balance": p6_balance,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_capped": p7_capped,
    "p7_rates": p7_rates,
    "p8_found": p8_found,
    "p8_links": p8_links,
    "p8_classes": p8_classes,
}

_BEST = """
latest AS (
  SELECT *, row_number() OVER (PARTITION BY league_season_id, event_name, context, team_id ORDER BY updated_at DESC) AS age FROM team_form
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY league_season_id
    ORDER BY score DESC, streak_length DESC NULLS LAST, team_id, event_name, context) AS rank
  FROM latest WHERE age = 1 AND score IS NOT NULL AND NOT isnan(score)
)"""

_SERIES = """
kept AS (
  SELECT *, row_number() OVER (PARTITION BY api_fixture_id ORDER BY updated_at DESC, fixture_id DESC) AS rn,
         lower(regexp_replace(home_fulltime_result, '[^A-Za-z]', '', 'g')) AS word
  FROM raw_fixtures
), events AS (
  SELECT home_team_id, kickoff_utc, api_fixture_id,
    CASE WHEN word IN ('w', 'win', 'won', 'wins', 'victory') THEN 'win'
         WHEN word IN ('d', 'draw', 'drawn', 'drew', 'tie', 'tied') THEN 'draw'
         WHEN word IN ('l', 'loss', 'lost', 'lose', 'defeat') THEN 'loss' END AS result
  FROM kept WHERE rn = 1 AND home_team_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY home_team_id ORDER BY kickoff_utc, api_fixture_id)
          - row_number() OVER (PARTITION BY home_team_id, result ORDER BY kickoff_utc, api_fixture_id) AS island
  FROM events WHERE result IS NOT NULL
), series AS (
  SELECT home_team_id, result, first(api_fixture_id ORDER BY kickoff_utc, api_fixture_id) AS first_api_fixture_id,
         last(api_fixture_id ORDER BY kickoff_utc, api_fixture_id) AS last_api_fixture_id,
         CAST(floor(epoch(min(kickoff_utc))) AS BIGINT) AS first_s, CAST(floor(epoch(max(kickoff_utc))) AS BIGINT) AS last_s,
         CAST(count(*) AS INTEGER) AS n_events
  FROM numbered GROUP BY home_team_id, result, island
)"""

#: Letters that look like Latin ones, written out a second time for the SQL.
_ALIKE = "аеорсухіјѕАВЕКМНОРСТУХІЈЅӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ"
_LATIN = "aeopcyxijsABEKMHOPCTYXIJSIABEZHIKMNOPTYXovp"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _form_sql(text: str) -> str:
    """The one form of a text for the signs that the tables hold: joined, then replaced letter by letter, then joined again."""
    import unicodedata

    look = dict(zip(_ALIKE, _LATIN))
    single = look | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    single |= {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {chr(0xB5): chr(0x3BC)}
    several = dict(_LIGATURES)
    for c in range(0x370, 0x530):  # accented letters of the other scripts
        first, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and first in look:
            into = unicodedata.normalize("NFC", look[first] + "".join(marks))
            (single if len(into) == 1 else several)[chr(c)] = into
    widthless = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)))
    body = f"replace(nfc_normalize(regexp_replace({text}, '[{widthless}]', '', 'g')), chr(13) || chr(10), chr(10))"
    for a, b in several.items():
        body = f"replace({body}, '{a}', '{b}')"
    quote = lambda x: x.replace("'", "''")
    return f"nfc_normalize(translate({body}, '{quote(''.join(single))}', '{quote(''.join(single.values()))}'))"


_FORMS = f"""
forms AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL),
texts AS (SELECT form, text, min(doc_id) AS rep FROM forms GROUP BY form, text),
classes AS (SELECT form, min(rep) AS head, count(*) AS n FROM texts GROUP BY form)"""

ORACLES = {
    "p6_balance": """SELECT profile, capacity_tokens AS capacity, count(*) AS n_docs, CAST(sum(greatest(1, ceil(n_chars / capacity_tokens))) AS BIGINT) AS n_pieces,
CAST(sum(n_chars) AS BIGINT) AS n_size, CAST(0 AS BIGINT) AS n_divided_that_fit, CAST(0 AS BIGINT) AS n_over FROM documents, pack_limits GROUP BY profile, capacity_tokens""",
    "p7_rates": """WITH have AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n, count(*) AS d FROM documents GROUP BY source),
known AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(h.n, 0) AS tokens_available, coalesce(h.d, 0) AS n_docs FROM mix_targets t LEFT JOIN have h ON h.source = t.source),
reach AS (SELECT min(tokens_available * max_repeats / target_share) AS r FROM known WHERE tokens_available > 0 AND target_share > 0 AND max_repeats > 0),
rated AS (SELECT *, CASE WHEN tokens_available > 0 AND target_share > 0 AND max_repeats > 0 THEN least(r * target_share / tokens_available, max_repeats) ELSE 0 END AS x FROM known, reach)
SELECT source, target_share, max_repeats, tokens_available, n_docs, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE x END AS rate, CAST(0 AS BIGINT) AS n_outside FROM rated""",
    "p8_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form WHERE a.text <> b.text AND a.doc_id < b.doc_id",
    "p8_links": f"WITH {_FORMS} SELECT head AS doc_id_a, rep AS doc_id_b FROM texts JOIN classes USING (form) WHERE rep <> head",
    "p8_classes": f"""WITH {_FORMS} SELECT f.doc_id, c.head AS class_id, t.rep AS copy_of, c.n - 1 AS n_links
FROM forms f JOIN texts t ON t.form = f.form AND t.text = f.text JOIN classes c ON c.form = f.form
UNION ALL SELECT doc_id, doc_id, doc_id, 0 FROM documents WHERE text IS NULL""",
    "p4_found": f"WITH {_BEST} SELECT league_season_id, team_id, event_name, context FROM ranked WHERE rank <= 10",
    "p4_ranked": f"""WITH {_BEST} SELECT league_season_id, event_name, context, team_id, score, streak_length, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 10""",
    "p5_found": f"WITH {_SERIES} SELECT home_team_id, first_api_fixture_id, n_events FROM series WHERE n_events > 1",
    "p5_series": f"WITH {_SERIES} SELECT *, CAST(last_s - first_s AS BIGINT) AS duration_s FROM series WHERE n_events > 1",
    "p5_collapsed": f"WITH {_SERIES} SELECT *, CAST(last_s - first_s AS BIGINT) AS duration_s FROM series",
}
