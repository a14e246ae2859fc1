"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest (DataFrame functions and Spark ML only)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules (verdict, host and path) of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: The words that the labelled table is made of, by verdict and theme; fixed values.  A table of hosts, paths and whole URLs comes of them by rule.
THEMES = {
    "allow": """
        museum history archive gallery painting sculpture heritage exhibition curator collection
        garden kitchen recipes bakery vineyard farmers harvest pottery knitting carpentry
        university school chemistry astronomy physics biology geology mathematics lecture faculty
        weather climate forest ocean mountain river harbour lighthouse aquarium birdwatching
        library bookshop poetry dictionary encyclopedia linguistics philosophy genealogy reading author
        council parliament tax-office post-office courthouse fire-brigade police transport railway airport
        programming software database network electronics tutorial documentation compiler notebook forum
        hospital medicine nursing dental veterinary nutrition psychology health clinic therapy
        orchestra theatre cinema festival jazz choir concert photography architecture fashion
        football cycling hiking chess puzzle crossword travel hotel newspaper journal
    """,
    "block": """
        casino poker roulette blackjack slots jackpot betting gambling lottery bingo
        porn xxx sex nude naked webcam-girls escort milf hookup adult-videos
        viagra cialis pills no-prescription steroids diet-pills painkillers xanax valium tramadol
        payday-loan quick-cash easy-money bad-credit get-rich crypto-doubler bitcoin-giveaway forex-profit millionaire instant-loan
        replica-watches fake-rolex fake-passport counterfeit replica-bags designer-fakes fake-diploma fake-id cheap-rolex knockoff
        phishing verify-account login-confirm password-reset paypal-verify bank-alert prize-claim gift-card-free winner-survey free-iphone
        keygen crack warez serial-keys torrent-pirate cracked-exe virus trojan malware spyware
        spam-mailer backlinks buy-followers cheap-likes link-farm popup-ads click-fraud tracking-pixel ad-tracker doorway
    """,
}
#: Syllables of hosts that say nothing, which are allowed; and what surrounds hosts and names no theme.
SYLLABLES = "ba den fi gor ha ing ka lo men ni or pel qui ra sto tha un ver wol zet".split()
PREFIXES, DOMAINS = ("", "www.", "m.", "blog."), (".com", ".org", ".net", ".info", ".example.com", ".example.org", ".example.net", ".co.uk")
PLAIN_PATHS = ("", "/", "/index.html", "/{n}.html", "/news/2019/07/article-{n}", "/p/{n}", "/{n}", "/{n}/page-2")
FOLDERS = ("", "/en", "/de", "/fr", "/es", "", "/blog")
#: One host in so many is held out.
HELD_OUT = 4
#: Hash buckets; n-gram sizes; ridge penalty; rows that a labelled table may have.
BUCKETS, GRAMS, PENALTY, MAX_LABELLED = 1 << 13, (3, 4), 0.0003, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule, as struct(rule, verdict), for its host or a subdomain and a path that starts with the rule's; null if none fits."""
    fits = []
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        on_host = (host == own) | host.endswith("." + own)
        hit = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(slash + rest), hit))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart by a prefix, with marks at both ends."""

    def grams(name: str, part: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), part, F.lit("$"))
        last = F.greatest(F.length(marked) - (n - 1), F.lit(1))  # shorter parts are one gram
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(name), F.substr(marked, i, F.lit(n))))

    return F.concat(*[grams(name, part, n) for name, part in (("h", host), ("p", path)) for n in GRAMS])


def _features(df: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="_grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    return hashed.transform(df.withColumn("_grams", _grams(F.col("host"), F.col("path")))).drop("_grams")


def _hosts(verdict: str) -> list[tuple[str, list[str]]]:
    """Hosts of a verdict, each with the words of its theme: single words and pairs of neighbours at three distances."""
    out = []
    for line in THEMES[verdict].split("\n"):
        words = line.split()
        for i, w in enumerate(words):
            out += [(w, words), *((f"{w}{'-' if k < 3 else ''}{words[(i + k) % len(words)]}", words) for k in (1, 2, 3))]
    return out


def default_labels(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The labelled table as (url, verdict): what is trained from, or the URLs of the hosts held out.

    A host of either verdict stands with plain paths and with paths of its theme.
    A path of a blocked theme on an allowed host is blocked, as is any path on a
    blocked host.  Hosts of mere syllables are allowed.
    """
    rows, bad = [], [w for line in THEMES["block"].split("\n") for w in line.split()]
    url = lambda i, host, path: f"http{'s' * (i % 2)}://{PREFIXES[i % 4]}{host}{DOMAINS[i // 3 % 8]}{path}"
    plain = lambda i: FOLDERS[i % 7] + PLAIN_PATHS[i // 7 % 8].format(n=i * 37 % 9973)
    themed = lambda i, words: (f"{FOLDERS[i % 7]}/{words[i % len(words)]}/{words[(i + 3) % len(words)]}-{i}", f"{FOLDERS[(i + 1) % 7]}/{words[(i + 5) % len(words)]}.html")
    for verdict in THEMES:
        for i, (host, words) in enumerate(_hosts(verdict)):
            if ((i + i // 4) % HELD_OUT == 0) == held_out:  # a word's four hosts take turns
                rows += [(url(i + k, host, path), verdict) for k, path in enumerate((plain(i), plain(i * 5 + 3), plain(i * 11 + 4), *themed(i, words)))]
                if verdict == "allow":
                    rows += [(url(i + k, host, path), "block") for k, path in enumerate(themed(i * 3, bad))]
    n = len(SYLLABLES)
    for i in range(n * n):
        host = SYLLABLES[i % n] + SYLLABLES[i // n] + SYLLABLES[i * 7 % n] * (i % 3 > 0)
        if (i % HELD_OUT == HELD_OUT - 1) == held_out:
            rows += [(url(i + k, host, plain(i * 3 + k)), "allow") for k in range(3)]
    return spark.createDataFrame(rows, "url string, verdict string")


def train(labelled: DataFrame):
    """A logistic model of P(block) from a table (url, verdict) of allow and block rows; other verdicts and nulls are left out."""
    known = labelled.where(F.col("verdict").isin("allow", "block") & F.col("url").isNotNull())
    if known.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    rows = known.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.col("verdict") == "block").cast("double").alias("label"))
    return LogisticRegression(maxIter=60, regParam=PENALTY, standardization=False).fit(_features(rows.coalesce(1)))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, model=None, threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, p_block.

    The longest rule that fits decides; else the page is blocked if the
    classifier's probability is at least ``threshold``.  A page without a url, or
    with neither host nor path, is allowed unless a rule fits.  Rows are judged
    alone: repeats get the same verdict, an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    model = model or train(default_labels(pages.sparkSession))
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = model.transform(_features(parts)).withColumn("p_block", vector_to_array("probability")[1])
    scored = scored.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules))
    bare = (F.col("host") == "") & (F.col("path") == "")
    own = F.when((F.col("p_block") >= threshold) & ~bare, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", own).alias("verdict"), "p_block")
