"""URL filters, in DataFrame operations only: rules first, then a logistic regression.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; of rules that fit the longest wins
(of equally long ones the first by code point).

Urls without a rule are judged by a logistic regression on hashed character n-grams of host and path. It is trained by
stochastic gradient steps over a small labelled table, at most ``SEED_ROWS`` rows, of which the first by url are used: a fold inside one row, so
the model is one array of ``DIMENSIONS`` weights and a bias, of fixed size whatever the corpus. N-grams are taken from ``^host$`` and
``^path$`` apart; counts are divided by the square root of their number, and weighed by how rare the slot is in the labelled table (the logarithm of rows by rows
that have it), so that what all urls share does not drown the words. The weights that come out have this factor in them.

Defined cases: null urls and urls without ``://`` have empty host and path and no n-grams, and are allowed; url length is not
limited; repeated urls get equal rows; an empty table gives no rows; an empty labelled table gives the verdict ``allow``; columns that
clash with the new ones are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import saved, table

BLOCK, ALLOW = "block", "allow"
#: (verdict, host with path).
RULES = (
    (BLOCK, "com/en/"),
    (ALLOW, "example.com/en/7"),
    (ALLOW, "net/de/"),
    (BLOCK, "example.net/de/8"),
    (BLOCK, "org/es/"),
)
DIMENSIONS = 4096
GRAMS = (2, 3, 4)
EPOCHS, RATE, DECAY = 8, 0.5, 1e-4
SEED_ROWS = 1024
THRESHOLD = 0.5

# The words of which the labelled table is made.
UNWANTED = """casino poker slots betting porn xxx nude escort viagra pills pharmacy payday loans torrent warez crack keygen spam phishing malware adserver doubleclick tracker popunder clickbank
jackpot roulette blackjack gambling sportsbet lottery bingo wager sexcam adultdating hotgirls webcamsex hentai fetish milf cialis tramadol xanax steroids dietpills weightloss forex cryptoprofit getrich
bitcoindouble quickcash creditfix nulled serials hacktool botnet exploitkit freedownload fullcrack seedbox pirated adclick adsystem banners popads clicktrack affiliate trackpixel telemetry linkfarm
backlinks doorway typosquat fakelogin verifyaccount prizewinner giftcards surveyreward replicawatch knockoff""".split()
WANTED = """news wiki library school university science history museum garden recipes weather travel forum blog docs books music health sports city
college academy research journal physics biology chemistry mathematics archive gallery theatre orchestra cooking baking hiking cycling climbing sailing fishing photography astronomy geology
hospital clinic nursing community council government parliament embassy railway airport harbour transport engineering software developer tutorial reference dictionary encyclopedia magazine newspaper
radio television podcast literature poetry philosophy theology architecture design fashion crafts knitting woodwork farming forestry wildlife birds aquarium national parks heritage""".split()
NEUTRAL = "alder birch cedar the and river stone north there ering atlas ridge other thing inland nation order harbor thorn meadow".split()
SHAPES = ("http://{}.example.com/index", "https://www.{}-site.net/fr/12?page=1", "http://example.org/{}/a.html", "https://my.example.com/{}", "http://{}.info/", "http://top{}1.example.net/de/4")


def labelled_urls(spark: SparkSession, left_out: frozenset[str] = frozenset()) -> DataFrame:
    """The default labelled table ``(url, blocked)``: words of either kind, each in four of six places in turn, and pages of hosts without meaning. ``left_out``: words that
    are not used, to measure what is learned of the others."""
    rows = []
    for blocked, words in ((1, UNWANTED), (0, WANTED)):
        for at, word in enumerate(words):
            if word not in left_out:
                rows += [(SHAPES[(at + k) % len(SHAPES)].format(word), blocked) for k in range(4)]
    for at, word in enumerate(NEUTRAL):
        rows += [(f"http://{word}.example.{('com', 'net', 'org')[(at + k) % 3]}/{lang}/{37 * at + 211 * k}?page=2", 0) for k, lang in enumerate(("en", "fr", "de", "es"))]
    for word in ("en", "fr", "de", "es"):
        rows += [(f"http://{host}.example.{top}/{word}/{n}?page=2", 0) for host in ("alpha", "omega") for top in ("com", "net", "org") for n in (3, 25, 417)]
    return spark.createDataFrame(rows, "url string, blocked int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict, both null where none fits."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest if _ else "")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def gram_slots(host: str = "host", path: str = "path") -> Column:
    """Slots (from 1) of the hashed n-grams of two named columns."""
    parts = []
    for name in (host, path):
        for n in GRAMS:
            slot = f"cast(pmod(xxhash64('{name}', substring(e, i, {n})), {DIMENSIONS}) as int) + 1"
            # the text is bound once: a column that a lambda names would be fetched anew at every n-gram
            parts.append(f"""if({name} = '' or char_length({name}) < {n - 2}, cast(array() as array<int>),
                transform(array('^' || {name} || '$'), e -> transform(sequence(1, char_length(e) - {n - 1}), i -> {slot}))[0])""")
    return F.expr(f"concat({', '.join(parts)})")


def train(labelled: DataFrame) -> list[float]:
    """Weights by slot, then the bias."""
    host, path = host_and_path(F.col("url"))
    first = labelled.where("blocked is not null").select("url", "blocked").distinct().orderBy("url", "blocked").limit(SEED_ROWS)
    rows = first.withColumns({"host": host, "path": path}).select(F.col("blocked").cast("double").alias("y"), gram_slots().alias("slots"), F.xxhash64("url", "blocked").alias("at"))
    # of each row the counts of its n-grams, laid out by slot once; a step reads only the slots that it has, and adds a multiple of the row to the weights
    rows = saved(rows)
    counts = rows.select("at", F.explode(F.concat("slots", F.sequence(F.lit(1), F.lit(DIMENSIONS)))).alias("d")).groupBy("at", "d").agg((F.count(F.lit(1)) - 1).alias("c"))
    total = rows.count()
    having = {r["d"]: r["count"] for r in counts.where("c > 0").groupBy("d").count().collect()}  # DIMENSIONS numbers at most
    rare = [log((total + 1) / (having.get(d, 0) + 1)) for d in range(1, DIMENSIONS + 1)]
    rarity = F.split(F.lit(" ".join(map(repr, rare))), " ").cast("array<double>")
    laid = counts.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("c")).join(rows, "at").withColumn("root", F.sqrt(F.greatest(F.size("slots"), F.lit(1))))
    laid = laid.withColumn("x", F.zip_with("c", rarity, lambda v, r: v["c"] * r / F.col("root")))
    laid = saved(laid.select("at", "y", "slots", "root", F.expr("concat(x, array(1D))").alias("x")))
    both = laid.agg(F.sort_array(F.collect_list(F.struct("at", "y", "slots", "root", "x"))).alias("rows"), F.sum(F.lit(1.0)).alias("n"), F.sum("y").alias("ones")).withColumn("rarity", rarity)
    # either class weighs half
    one = both.withColumn("rows", F.expr("transform(rows, r -> named_struct('y', r.y, 'slots', r.slots, 'root', r.root, 'x', r.x, 'm', n / (2 * greatest(if(r.y = 1, ones, n - ones), 1))))"))
    margin = f"(aggregate(r.slots, 0D, (s, d) -> s + get(w, d - 1) * get(rarity, d - 1)) / r.root + get(w, {DIMENSIONS}))"
    step = f"""aggregate(rows, w0, (w, r) -> transform(array(r.m * (r.y - 1 / (1 + exp(-{margin})))),
        g -> zip_with(w, r.x, (a, b) -> a * {1 - DECAY} + {RATE} * g * b))[0])"""
    fold = f"aggregate(sequence(1, {EPOCHS}), transform(sequence(0, {DIMENSIONS}), i -> 0D), (w0, e) -> {step})"
    found = saved(one).select(F.expr(fold).alias("w")).first()["w"]
    return [w * r for w, r in zip(found, [*rare, 1.0])]


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` (of being unwanted) and ``verdict``."""
    host, path = host_and_path(F.col("url"))
    found = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    # a constant array: folded once, and of fixed size
    model = F.split(F.lit(" ".join(repr(float(w)) for w in weights)), " ").cast("array<double>")
    found = found.withColumns({"rule": rule, "__v": verdict, "__s": gram_slots()})
    total = F.aggregate("__s", F.lit(0.0), lambda s, d: s + F.get(model, d - 1))
    score = 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("__s"), F.lit(1))) + F.lit(float(weights[DIMENSIONS])))))
    found = found.withColumn("score", score)
    return found.withColumn("verdict", F.coalesce("__v", F.when((F.col("score") > THRESHOLD) & (F.size("__s") > 0), BLOCK).otherwise(ALLOW))).drop("__v", "__s")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
