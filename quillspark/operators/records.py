"""Job-like records: field extraction from prose, scores and ranking, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Patterns of years of experience, and words of seniority with what they stand for.
YEARS = [
    r"(\d+)\s*\+?\s*(?:years?|yrs?)\s*(?:of)?\s*(?:experience|exp)",
    r"(\d+)\s*-\s*\d+\s*(?:years?|yrs?)",
    r"(\d+)\s*(?:years?|yrs?)\s*(?:experience|exp)",
]
SENIORITY = [
    (0, ["entry level", "entry-level", "junior", "fresher", "intern"]),
    (3, ["mid-level", "mid level", "intermediate"]),
    (5, ["senior", "sr.", "lead", "principal", "staff"]),
]
YEARS_TEXT = [
    r"(?i)(\d+)\s*\+?\s*(?:years?|yrs?)\s*(?:of\s*)?(?:experience|exp)",
    r"(?i)experience\s*(?:of\s*)?(\d+)\s*\+?\s*(?:years?|yrs?)",
    r"(?i)minimum\s*(\d+)\s*(?:years?|yrs?)",
]
YEARS_RANGE = r"(?i)(\d+)\s*-\s*(\d+)\s*(?:years?|yrs?)\s*(?:of\s*)?(?:experience|exp)"
BANDS = [
    ("0-1 years", ["fresher", "entry level", "entry-level", "0-1 year", "intern"]),
    ("1-3 years", ["junior", "associate"]),
    ("3-5 years", ["mid-level", "mid level", "intermediate"]),
    ("5+ years", ["senior", "sr.", "lead"]),
    ("8+ years", ["principal", "staff", "architect"]),
]

# Patterns of pay, in order.
SALARY = [
    r"(?i)(?:₹|Rs\.?|INR)\s*(\d[\d,.]*)\s*(?:L|lakh|lac|LPA)",
    r"(?i)(\d[\d,.]*)\s*-\s*(\d[\d,.]*)\s*(?:L|lakh|lac|LPA)",
    r"(?i)\$\s*(\d[\d,]*)\s*[kK]?\s*[-–]\s*\$?\s*(\d[\d,]*)\s*[kK]?",
    r"(?i)\$\s*(\d[\d,]+)",
    r"(?i)CTC\s*(?:of\s*)?(?:₹|Rs\.?)?\s*(\d[\d,.]*)\s*(?:L|lakh|LPA)",
]

# Patterns of skills, in order; a word boundary stands on both sides.
SKILLS = [
    "python", "java", "javascript", "typescript", "go", "golang", "rust", "c\\+\\+", "c#", "ruby", "php", "swift", "kotlin", "scala", "r\\b",
    "react", "angular", "vue", "next\\.?js", "node\\.?js", "express", "django", "flask", "fastapi", "spring", "spring boot",
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s", "terraform", "ansible", "jenkins", "ci/cd", "github actions",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "kafka", "rabbitmq", "graphql", "rest api", "grpc",
    "machine learning", "deep learning", "nlp", "computer vision", "pytorch", "tensorflow", "pandas", "numpy", "scikit-learn",
    "sql", "nosql", "data engineering", "etl", "airflow", "microservices", "system design", "distributed systems", "linux", "git", "agile", "scrum",
]

# Phrases that hint at a kind of company.
PRODUCT_SIGNALS = ["our product", "our platform", "ship features", "product team", "b2c", "b2b saas", "consumer app", "our users", "user growth", "product-market fit", "product roadmap", "feature development"]
SERVICE_SIGNALS = ["client projects", "client-facing", "consulting engagement", "delivery team", "onsite", "offshore", "billable hours", "multiple clients", "client requirements", "staffing", "managed services", "it outsourcing"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def years_of_experience(text: Column) -> Column:
    """Years by the first pattern that matches, else by a word of seniority, else null."""
    low = F.lower(text)
    by_word = reduce(lambda out, x: F.when(_any(low, x[1]), x[0]).otherwise(out), reversed(SENIORITY), F.lit(None).cast("int"))
    return F.coalesce(T.first_match(low, YEARS, 1).try_cast("int"), by_word)


def experience_text(text: Column) -> Column:
    """The same as a label, such as 5+ years or 1-3 years; empty if nothing is known."""
    low = F.lower(text)
    plus = [F.concat(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit("+ years")) for p in YEARS_TEXT]
    span = F.concat(F.nullif(F.regexp_extract(text, YEARS_RANGE, 1), F.lit("")), F.lit("-"), F.regexp_extract(text, YEARS_RANGE, 2), F.lit(" years"))
    by_word = reduce(lambda out, x: F.when(_any(low, x[1]), x[0]).otherwise(out), reversed(BANDS), F.lit(""))
    return F.coalesce(plus[0], span, *plus[1:], by_word)


def salary_text(text: Column) -> Column:
    return F.coalesce(F.trim(T.first_match(text, SALARY)), F.lit(""))


def skills(text: Column, most: int = 15) -> Column:
    """Names of the skills that occur, in the list's order, at most so many."""
    low = F.lower(text)
    name = lambda p: p.replace("\\+", "+").replace("\\.?", ".?").replace("\\b", "")
    found = F.array(*[F.when(low.rlike(rf"\b{p}\b"), name(p)) for p in SKILLS])
    return F.slice(F.array_compact(found), 1, most)


def rating_and_size(text: Column) -> tuple[Column, Column]:
    rating = F.regexp_extract(text, r"(?i)(\d\.\d)\s*/?\s*5(?:\.\d)?\s*(?:stars?|rating)", 1).try_cast("double")
    size = F.replace(F.regexp_extract(text, r"(?i)(\d[\d,]*)\s*(?:employees|staff|people)", 1), F.lit(","), F.lit("")).try_cast("long")
    return rating, size


def founding_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(?:founded|established|incorporated)\s*(?:in\s*)?(\d{4})", 1).try_cast("int")


def company_kind(text: Column) -> Column:
    """Kind by the phrases present; two or more of the leading side are needed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    product, service = T.count_present(low, PRODUCT_SIGNALS), T.count_present(low, SERVICE_SIGNALS)
    return (
        F.when((product > service) & (product >= 2), "product")
        .when((service > product) & (service >= 2), "service")
        .when(_any(low, ["consulting"]) & _any(low, ["partner"]), "consulting")
        .when(_any(low, ["startup", "seed", "series a"]), "startup")
        .otherwise("unknown")
    )


def salary_range(low: Column, high: Column) -> Column:
    money = lambda c: F.concat(F.lit("$"), F.format_number(c.cast("long"), 0))
    return F.when((low > 0) & (high > 0), F.concat(money(low), F.lit(" – "), money(high))).when(low > 0, F.concat(F.lit("From "), money(low))).otherwise("")


def salary_score(text: Column, top: int = 250_000) -> Column:
    numbers = F.transform(F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.least(F.lit(100.0), F.coalesce(F.array_max(numbers), F.lit(0.0)) / top * 100)


def relevance_score(title: Column, keywords: list[str]) -> Column:
    if not keywords:
        return F.lit(50.0)
    return T.count_present(F.coalesce(title, F.lit("")), [k.lower() for k in keywords]) / len(keywords) * 100


def company_score(kind: Column, preferred: str, employees: Column, known_source: Column) -> Column:
    kind = F.coalesce(kind, F.lit("unknown"))
    fit = F.when(kind == preferred, 25.0).when(kind == "unknown", 0.0).otherwise(-10.0)
    size = F.when(employees >= 1000, 15.0).when(employees >= 100, 10.0).when(employees >= 10, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(50.0) + fit + size + F.when(known_source, 10.0).otherwise(0.0)))


def recency_score(day: Column, as_of: str) -> Column:
    """Bands of age in days; 50 where the date is null or unreadable."""
    age = F.datediff(F.to_date(F.lit(as_of)), day)
    bands = [(1, 100.0), (3, 85.0), (7, 70.0), (14, 50.0), (30, 30.0)]
    return F.when(age.isNull(), 50.0).otherwise(reduce(lambda out, b: F.when(age <= b[0], b[1]).otherwise(out), reversed(bands), F.lit(10.0)))


def weighted_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores; the weights are normalised (all zero: 0)."""
    total = sum(weights.values()) or 1.0
    return reduce(lambda a, b: a + b, [scores[k] * (w / total) for k, w in weights.items()])


def red_flags(employees: Column, rating: Column, funded: Column, year: int) -> Column:
    return F.array_compact(F.array(
        F.when(employees < 10, "Very small company (<10 employees)"),
        F.when(rating < 3.0, F.concat(F.lit("Low Glassdoor rating ("), rating.cast("string"), F.lit(")"))),
        F.when(year - funded > 3, F.concat(F.lit("Last funded "), (year - funded).cast("string"), F.lit(" years ago"))),
    ))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _titles(s, d):
    """Titles with hints, made from parts."""
    k = F.col("p_partkey")
    hint = (
        F.when(k % 7 == 0, F.concat(F.lit(" 5-"), (k % 9 + 5).cast("string"), F.lit(" years of experience")))
        .when(k % 7 == 1, F.concat((k % 12).cast("string"), F.lit("+ yrs exp, $"), F.format_number(k * 100, 0)))
        .when(k % 7 == 2, " Senior python and C++ developer, node.js, SQL")
        .when(k % 7 == 3, " international, 10-20 LPA, founded in 1999 with 1,200 employees")
        .when(k % 7 == 4, " mid level; 4.5 / 5 stars; our product, our users")
        .otherwise("")
    )
    return _read(s, d, "part").select("p_partkey", F.concat("p_name", hint).alias("t"), "p_retailprice", "p_size", "p_type")


_TITLES = """(SELECT p_partkey, p_retailprice, p_size, p_type, p_name || CASE p_partkey % 7 WHEN 0 THEN ' 5-' || (p_partkey % 9 + 5)::VARCHAR || ' years of experience'
  WHEN 1 THEN (p_partkey % 12)::VARCHAR || '+ yrs exp, $' || format('{:,}', p_partkey * 100) WHEN 2 THEN ' Senior python and C++ developer, node.js, SQL'
  WHEN 3 THEN ' international, 10-20 LPA, founded in 1999 with 1,200 employees' WHEN 4 THEN ' mid level; 4.5 / 5 stars; our product, our users' ELSE '' END AS t FROM part)"""


def _has(words: list[str], text: str = "lower(t)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _first(patterns: list[str], group: int, text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', {group}), '')" for p in patterns) + ")"


_YEARS_SQL = f"coalesce(try_cast({_first(YEARS, 1, 'lower(t)')} AS INT), CASE " + " ".join(f"WHEN {_has(w)} THEN {n}" for n, w in SENIORITY) + " END)"
_PLUS = [f"nullif(regexp_extract(t, '{p}', 1), '') || '+ years'" for p in YEARS_TEXT]
_SPAN = f"nullif(regexp_extract(t, '{YEARS_RANGE}', 1), '') || '-' || regexp_extract(t, '{YEARS_RANGE}', 2) || ' years'"
_TEXT_SQL = f"coalesce({_PLUS[0]}, {_SPAN}, {_PLUS[1]}, {_PLUS[2]}, CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in BANDS) + " ELSE '' END)"
_SKILL_SQL = ", ".join("CASE WHEN regexp_matches(lower(t), '\\b" + p + "\\b') THEN '" + p.replace("\\+", "+").replace("\\.?", ".?").replace("\\b", "") + "' END" for p in SKILLS)
_COUNT = lambda words: " + ".join(f"contains(lower(t), '{w}')::INT" for w in words)
_SALARY_SCORE = "least(100.0::DOUBLE, coalesce(list_max(list_transform(regexp_extract_all(replace(coalesce(t, ''), ',', ''), '\\d+'), lambda x: x::DOUBLE)), 0.0) / 250000 * 100)"
_AGE = "date_diff('day', o_orderdate::DATE, DATE '1998-08-01')"
_RECENCY = f"CASE WHEN {_AGE} <= 1 THEN 100.0 WHEN {_AGE} <= 3 THEN 85.0 WHEN {_AGE} <= 7 THEN 70.0 WHEN {_AGE} <= 14 THEN 50.0 WHEN {_AGE} <= 30 THEN 30.0 ELSE 10.0 END"
_COMPANY = """greatest(0.0, least(100.0, 50.0 + CASE WHEN c_mktsegment = 'BUILDING' THEN 25.0 WHEN c_mktsegment IS NULL THEN 0.0 ELSE -10.0 END
  + CASE WHEN c_acctbal >= 1000 THEN 15.0 WHEN c_acctbal >= 100 THEN 10.0 WHEN c_acctbal >= 10 THEN 5.0 ELSE 0.0 END + CASE WHEN c_nationkey < 5 THEN 10.0 ELSE 0.0 END))::DOUBLE"""
_KEYWORDS = ["red", "widget", "large"]
_RELEVANCE = "((contains(lower(t), 'red')::INT + contains(lower(t), 'widget')::INT + contains(lower(t), 'large')::INT) / 3.0::DOUBLE * 100)"
_WEIGHTS = {"salary": 0.25, "relevance": 0.30, "size": 0.25}


def _scored(s, d) -> DataFrame:
    t = _titles(s, d)
    scores = {"salary": salary_score(F.col("t")), "relevance": relevance_score(F.col("t"), _KEYWORDS), "size": F.col("p_size").cast("double")}
    return t.withColumn("score", F.round(weighted_score(scores, _WEIGHTS) + 1e-9, 4))


_SCORED = f"(SELECT *, round({_SALARY_SCORE} * (0.25 / 0.8::DOUBLE) + {_RELEVANCE} * (0.3 / 0.8::DOUBLE) + p_size * (0.25 / 0.8::DOUBLE) + 1e-9::DOUBLE, 4) AS score FROM {_TITLES})"

QUERIES = {
    "e01_years": lambda s, d: _titles(s, d).select("p_partkey", years_of_experience(F.col("t")).alias("years")),
    "e02_experience": lambda s, d: _titles(s, d).select("p_partkey", experience_text(F.col("t")).alias("experience")),
    "e03_salary": lambda s, d: _titles(s, d).select("p_partkey", salary_text(F.col("t")).alias("salary")),
    "e04_skills": lambda s, d: _titles(s, d).select("p_partkey", F.array_join(skills(F.col("t")), ",").alias("skills")),
    "e05_rating": lambda s, d: _titles(s, d).select("p_partkey", rating_and_size(F.col("t"))[0].alias("rating"), rating_and_size(F.col("t"))[1].alias("employees")),
    "e06_founding_year": lambda s, d: _titles(s, d).select("p_partkey", founding_year(F.col("t")).alias("year")),
    "e07_salary_score": lambda s, d: _titles(s, d).select("p_partkey", F.round(salary_score(F.col("t")), 6).alias("score")),
    "e08_company_kind": lambda s, d: _titles(s, d).select("p_partkey", company_kind(F.col("t")).alias("kind")),
    "a24_record": lambda s, d: _titles(s, d).select("p_partkey", F.trim("t").alias("title"), salary_text(F.col("t")).alias("salary"), experience_text(F.col("t")).alias("experience"), F.left("t", F.lit(500)).alias("description")),
    "a25_salary_range": lambda s, d: _read(s, d, "part").select("p_partkey", salary_range(F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") * 100), F.when(F.col("p_partkey") % 2 > 0, F.col("p_retailprice") * 150)).alias("salary")),
    "d02_weights": lambda s, d: _read(s, d, "region").select("r_regionkey", F.round(F.col("r_regionkey") / F.nullif(F.sum("r_regionkey").over(Window.partitionBy()), F.lit(0)), 6).alias("weight")),
    "d03_relevance": lambda s, d: _titles(s, d).select("p_partkey", F.round(relevance_score(F.col("t"), _KEYWORDS), 6).alias("score")),
    "d04_company_score": lambda s, d: _read(s, d, "customer").select("c_custkey", company_score(F.col("c_mktsegment"), "BUILDING", F.col("c_acctbal"), F.col("c_nationkey") < 5).alias("score")),
    "d05_recency": lambda s, d: _read(s, d, "orders").select("o_orderkey", recency_score(F.to_date("o_orderdate"), "1998-08-01").alias("score")),
    "d06_final_score": lambda s, d: _scored(s, d).select("p_partkey", "score"),
    "d07_red_flags": lambda s, d: _read(s, d, "part").select("p_partkey", F.array_join(red_flags(F.col("p_size"), (F.col("p_partkey") % 50) / 10, 2000 + F.col("p_partkey") % 27, 2026), "; ").alias("flags")),
    "w12_rank": lambda s, d: _scored(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("score"), "p_partkey")).cast("long")).select("p_partkey", "p_type", "rank"),
    "g21_top_names": lambda s, d: _scored(s, d).groupBy("p_type").agg(F.round(F.avg("score"), 4).alias("average"), F.max_by("p_partkey", F.struct("score", -F.col("p_partkey"))).alias("best")),
    "f13_remote": lambda s, d: _titles(s, d).where((F.col("p_partkey") % 11 == 0) | F.contains(F.lower("t"), F.lit("international"))).select("p_partkey"),
    "f14_experience_bound": lambda s, d: _titles(s, d).where(F.coalesce(years_of_experience(F.col("t")) <= 6, F.lit(True))).select("p_partkey"),
}

SQL = {
    "e01_years": f"SELECT p_partkey, {_YEARS_SQL} AS years FROM {_TITLES}",
    "e02_experience": f"SELECT p_partkey, {_TEXT_SQL} AS experience FROM {_TITLES}",
    "e03_salary": f"SELECT p_partkey, coalesce(trim({_first(SALARY, 0, 't')}), '') AS salary FROM {_TITLES}",
    "e04_skills": f"SELECT p_partkey, array_to_string(list_filter([{_SKILL_SQL}], lambda x: x IS NOT NULL)[1:15], ',') AS skills FROM {_TITLES}",
    "e05_rating": rf"SELECT p_partkey, try_cast(regexp_extract(t, '(?i)(\d\.\d)\s*/?\s*5(?:\.\d)?\s*(?:stars?|rating)', 1) AS DOUBLE) AS rating, try_cast(replace(regexp_extract(t, '(?i)(\d[\d,]*)\s*(?:employees|staff|people)', 1), ',', '') AS BIGINT) AS employees FROM {_TITLES}",
    "e06_founding_year": rf"SELECT p_partkey, try_cast(regexp_extract(t, '(?i)(?:founded|established|incorporated)\s*(?:in\s*)?(\d{{4}})', 1) AS INT) AS year FROM {_TITLES}",
    "e07_salary_score": f"SELECT p_partkey, round({_SALARY_SCORE}, 6) AS score FROM {_TITLES}",
    "e08_company_kind": f"""SELECT p_partkey, CASE WHEN p > s AND p >= 2 THEN 'product' WHEN s > p AND s >= 2 THEN 'service' WHEN contains(l, 'consulting') AND contains(l, 'partner') THEN 'consulting'
      WHEN contains(l, 'startup') OR contains(l, 'seed') OR contains(l, 'series a') THEN 'startup' ELSE 'unknown' END AS kind
      FROM (SELECT p_partkey, lower(t) AS l, {_COUNT(PRODUCT_SIGNALS)} AS p, {_COUNT(SERVICE_SIGNALS)} AS s FROM {_TITLES})""",
    "a24_record": f"SELECT p_partkey, trim(t) AS title, coalesce(trim({_first(SALARY, 0, 't')}), '') AS salary, {_TEXT_SQL} AS experience, left(t, 500) AS description FROM {_TITLES}",
    "a25_salary_range": """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN '$' || format('{:,}', trunc(p_retailprice * 100)::BIGINT) || ' – $' || format('{:,}', trunc(p_retailprice * 150)::BIGINT)
      WHEN p_partkey % 3 > 0 THEN 'From $' || format('{:,}', trunc(p_retailprice * 100)::BIGINT) ELSE '' END AS salary FROM part""",
    "d02_weights": "SELECT r_regionkey, round(r_regionkey / sum(r_regionkey) OVER (), 6) AS weight FROM region",
    "d03_relevance": f"SELECT p_partkey, round({_RELEVANCE}, 6) AS score FROM {_TITLES}",
    "d04_company_score": f"SELECT c_custkey, {_COMPANY} AS score FROM customer",
    "d05_recency": f"SELECT o_orderkey, ({_RECENCY})::DOUBLE AS score FROM orders",
    "d06_final_score": f"SELECT p_partkey, score FROM {_SCORED}",
    "d07_red_flags": """SELECT p_partkey, coalesce(array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'Very small company (<10 employees)' END, CASE WHEN p_partkey % 50 < 30 THEN 'Low Glassdoor rating (' || ((p_partkey % 50) / 10.0::DOUBLE)::VARCHAR || ')' END,
      CASE WHEN 26 - p_partkey % 27 > 3 THEN 'Last funded ' || (26 - p_partkey % 27)::VARCHAR || ' years ago' END], lambda x: x IS NOT NULL), '; '), '') AS flags FROM part""",
    "w12_rank": f"SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS rank FROM {_SCORED}",
    "g21_top_names": f"SELECT p_type, round(avg(score), 4) AS average, arg_max(p_partkey, (score, -p_partkey)) AS best FROM {_SCORED} GROUP BY p_type",
    "f13_remote": f"SELECT p_partkey FROM {_TITLES} WHERE p_partkey % 11 = 0 OR contains(lower(t), 'international')",
    "f14_experience_bound": f"SELECT p_partkey FROM {_TITLES} WHERE coalesce({_YEARS_SQL} <= 6, true)",
}
