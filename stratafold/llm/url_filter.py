"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

Main path in DataFrame functions only: host and path come from string functions,
n-grams are hashed and their weights summed by higher-order functions, and the
regression is fitted by Spark's own estimator on a small labelled table of
different urls. ``THRESHOLD`` is the score that ``held_out`` finds best when each
fifth of the table is scored by a model of the other four; no page of a crawl is
used for it.

Null urls and urls without "://" have an empty host and path; such a url fits no
rule, and its n-grams are those of the empty address. A very long url is one row
whose n-grams are hashed within its task. Repeated rows are judged each on its own,
null ids pass through, urls with equal scores are judged alike, empty tables give
no rows, other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm.kernels import settled

# The rules, as (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BUCKETS = 4096
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.65
REGULARISATION = 0.0003
PATH_SCALE = 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table: names of two words of one class, by the rule of ``labelled``; endings, subdomains and paths are dealt to
# both classes alike, so that words decide. Other vocabularies and tables can be given.
BLOCKED_WORDS = (
    "viagra cialis pills pharma meds casino poker slots jackpot roulette bets betting gambling lottery porn xxx adult sex nude webcam escort erotic dating hookup "
    "spam bulk backlinks seo linkfarm clicks adserver popads tracker banner affiliate replica fake outlet cheap discount payday loans cash bonus win prize free giveaway "
    "doubler forex profit rich warez crack keygen torrent verify suspended miracle weightloss singles hotgirls"
).split()
ALLOWED_WORDS = (
    "library school museum garden river mountain council station nation education information mention notion ration history physics chemistry algebra theory thesis method weather "
    "harbour village theatre orchestra poetry journal letter writer reader author printing painting drawing walking hiking climbing cooking baking knitting sewing brewing "
    "bicycle railway timetable station airport harvest orchard farm market bakery kitchen recipe bread dinner winter summer spring autumn morning evening thunder feather "
    "leather together another mother brother father sister family children kindergarten teacher student lecture course reading notes archive record sound music choir concert "
    "hospital clinic doctor nurse health vaccine science research institute university college academy society union forum report survey census parliament court office "
    "zeitung rathaus verein reise wandern garten mairie ville livres culture ecole biblioteca noticias cocina historia ciudad camino shed thistle thorn there whale wheat "
    "onion bonnet stone strand house horse hanover anchor engine entrance blend table tower herring erosion edition order"
).split()
TLDS = ("com", "org", "net", "info", "biz")
SUBDOMAINS = ("", "www.", "", "blog.", "m.")
PATHS = ("/", "/about", "/en/12", "/de/881/", "/fr/7.html", "/es/41", "/index.html", "/page/3", "/news/today", "/order/55", "/download", "/login.php", "/category/4", "/contact")
#: Names of each word: with the words so many places further on.
STEPS = {"block": (1, 5, 11, 17), "allow": (1, 5, 11)}


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does."""
    text = action = F.lit(None).cast("string")
    for act, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        text, action = F.when(fits, F.lit(own + prefix)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def buckets(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """Hashed n-grams; all digits are alike.

    Those of the host's name, "^name$" without a leading www, m or blog and without its last label, have the lower half
    of the buckets, those of the last label and the path, "label path$", the upper half.
    """

    def grams(text: Column, first: int) -> Column:
        def of(chars: Column) -> Column:
            lists = []
            for n in GRAMS:
                places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
                gram = lambda i, n=n: F.concat(*(F.get(chars, i + j) for j in range(n)))
                lists.append(F.transform(places, lambda i: (F.pmod(F.xxhash64(gram(i)), F.lit(size // 2)) + first).cast("int")))
            return F.concat(*lists)

        # bound to a variable, so that the text is split once and not for each n-gram
        return F.flatten(F.transform(F.array(F.split(text, "")), of))

    host, path = (F.translate(c, "123456789", "0" * 9) for c in (host, path))
    name = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), r"\.[^.]*$", "")
    return F.concat(grams(F.concat(F.lit("^"), name, F.lit("$")), 0), grams(F.concat(F.regexp_extract(host, r"\.[^.]*$", 0), path, F.lit("$")), size // 2))


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1 block)."""
    rows = [("", 0.0)]
    for words, steps, label in ((BLOCKED_WORDS, STEPS["block"], 1.0), (ALLOWED_WORDS, STEPS["allow"], 0.0)):
        for i, one in enumerate(words):
            for j, step in enumerate(steps):
                name = ("-" if (i + j) % 2 else "").join((one, words[(i + step) % len(words)]))
                rows.append((f"https://{SUBDOMAINS[(i + 2 * j) % 5]}{name}.{TLDS[(i + j) % 5]}{PATHS[(3 * i + 5 * j) % len(PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def train(spark: SparkSession, table: DataFrame | None = None, size: int = BUCKETS) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept. The table is small by its definition: one row per labelled url."""
    table = labelled(spark) if table is None else table
    host, path = parts(F.col("url"))
    rows = settled(table.select("label", buckets(host, path, size).cast("array<string>").alias("hits")).coalesce(1))
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(size)], "hits", "ones", binary=True)
    # features of the path are smaller, so that the penalty weighs more on them: words of names decide
    scale = [1.0 if b < size // 2 else PATH_SCALE for b in range(size)]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="ones", outputCol="features").transform(counts.transform(rows))
    model = LogisticRegression(maxIter=40, regParam=REGULARISATION, standardization=False).fit(scaled)
    return [w * c for w, c in zip(model.coefficients.toArray().tolist(), scale)], float(model.intercept)


def scored(pages: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """The rows of pages with host, path and the regression's score of blocking."""
    weights, intercept = model
    host, path = parts(F.col("url"))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(F.array_distinct(buckets(F.col("host"), F.col("path"), len(weights))), F.lit(intercept), lambda s, b: s + F.get(table, b))
    return pages.withColumns({"host": host, "path": path}).withColumn("score", 1 / (1 + F.exp(-total)))


def held_out(spark: SparkSession, table: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """(url, label, score): every labelled url by a model of the other folds."""
    table = labelled(spark) if table is None else table
    fold = F.pmod(F.crc32("url"), F.lit(folds))
    out = None
    for k in range(folds):
        part = scored(table.where(fold == k), train(spark, table.where(fold != k))).select("url", "label", "score")
        out = part if out is None else out.unionByName(part)
    return out


def best_threshold(scores: DataFrame, steps: int = 19) -> tuple[float, float, float]:
    """The largest threshold of a row of steps whose F1 on held-out scores is within 0.005 of the best, as a page blocked wrongly costs more; with its precision and recall."""
    tried = scores.crossJoin(F.broadcast(scores.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("t"))))
    hit = F.col("score") >= F.col("t")
    rows = tried.groupBy("t").agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn")).orderBy("t").collect()
    f1 = [2 * r.tp / max(2 * r.tp + r.fp + r.fn, 1) for r in rows]
    best = [r for r, f in zip(rows, f1) if f >= max(f1) - 0.005]
    r = best[-1]
    return r.t, r.tp / max(r.tp + r.fp, 1), r.tp / max(r.tp + r.fn, 1)


def judge(pages: DataFrame, model: tuple[list[float], float], threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the regression's score of blocking."""
    rows = scored(pages.select("page_id", "url"), model)
    rule, action = rule_of(F.col("host"), F.col("path"))
    learnt = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, learnt).alias("verdict"), "score")
