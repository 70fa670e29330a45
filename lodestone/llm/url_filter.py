"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The rules are a short list; the model is trained with Spark ML from a small labelled URL table, a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash dimensions of each n-gram length, the lengths, the ridge penalty, and the probability from which a URL is blocked.
DIMENSIONS, LENGTHS, RIDGE, BLOCK_FROM = 1 << 12, (3, 4, 5), 0.0001, 0.5


@dataclass(frozen=True)
class Rule:
    """Fits `host` and all its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: Words of the labelled table, made by hand for this filter. A host with a word of BAD is to be blocked; words of BOTH stand in hosts of either kind.
BAD = "casino poker slots roulette bets betting wager jackpot lottery gambling porn xxx sex adult escort nude cams hookup viagra cialis pills pharma warez crack keygen torrent pirated nulled phish malware trojan exploit botnet spam scam hoax ads adserver adclick popads banners tracker tracking clickbait doorway linkfarm replica counterfeit payday slut milf hentai erotic fetish swinger hardcore blackjack baccarat bingo sportsbook betsafe levitra tramadol xanax steroids tabletten rezeptfrei potenzmittel".split()
BOTH = "win free cheap best farm track online live top hot fast easy bonus deals x24 1 pro club zone world store shop video chat games link links login home web now big".split()
GOOD = "news times herald city museum library school college garden kitchen travel weather science history music theatre health clinic sports cycling football forest river mountain bakery coffee books gazette council bank archive physics biology maths poetry cinema radio bridge harbour valley family children nature recipes hotel flights railway airport market village doctor lawyer design studio photo camera software data cloud maps wiki forum question answer parish church festival orchestra dance hiking sailing chess essex adulthood badminton pilsner lottie pillsbury sussex middlesex sextant scampi camshaft crackers cocktail peacock betterment alphabet winchester winnipeg downloads roads broadsheet gadsden trackside sluice milfoil pharmacy".split()
#: Paths of pages of good hosts that are about what bad ones offer.
TOPIC_PATHS = ("/wiki/{w}", "/questions/{n}/{w}-id", "/library/{w}.html", "/2021/05/{n}/{w}.html", "/article/about-{w}", "/tag/{w}", "/dictionary/{w}")
#: What stands around the words, alike for both kinds of host.
SUBDOMAINS, SUFFIXES = ("", "", "www.", "m.", "blog.", "news.", "shop."), ("example.com", "example.net", "example.org", "com", "net", "org", "info", "co.uk", "de")
PATHS = ("/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/about", "/index.html", "/blog/post/{n}", "/{n}", "/news/2021/{n}", "/category/{w}/{n}", "/{w}")
BAD_PATHS = ("/out/{w}?id={n}", "/go/{v}-{w}", "/click/{w}/{n}", "/aff/{w}-{v}", "/redirect/{v}-{w}", "/{w}-{w}-{v}/{w}")
#: Parts of invented names, as most hosts have.
ONSETS, CODAS = "b br c ch d f fl g gr h j k l m n p pl r s sh st t th tr v w wh z".split(), ("", "", "n", "nd", "ng", "r", "s", "st", "t", "th", "l", "m")
#: URLs to be blocked in the table, how many times as many are not, and every how many-th is held out of training.
LABELLED, MORE_GOOD, HELD_OUT = 1500, 4, 5


def labelled_rows(n: int = LABELLED, bad_words: list[str] = BAD) -> list[tuple[str, float, bool]]:
    """url, label (1 is to be blocked) and whether it is held out, made from the words by a fixed rule: three of four blocked URLs have a bad host with any path, the others a good host with a path that leads away to bad ones. One of four others is about a bad word, in its path."""

    def pick(values, *key):
        return values[crc32(repr(key).encode()) % len(values)]

    def invented(i):
        return "".join(pick(ONSETS, i, k) + pick("aeiou", i, k, "v") + pick(CODAS, i, k, "c") for k in range(1 + i % 3))

    def name(i, label, bad):
        first = pick(bad_words, i, "first") if bad else invented(i) if i % 3 else pick(GOOD, i, "first")
        second = invented(i + 1) if i % 5 == 0 else pick(BOTH, i, label, "second") if i % 2 else pick(bad_words if bad and i % 4 == 0 else GOOD, i, label, "second")
        return pick(("{0}-{1}", "{1}-{0}", "{0}{1}", "{0}", "{0}"), i, label, "shape").format(first, second)

    rows = []
    for label, total in ((0, MORE_GOOD * n), (1, n)):
        for i in range(total):
            bad_host = label == 1 and i % 4 > 0
            host = f"{pick(SUBDOMAINS, i, label, 'sub')}{name(i, label, bad_host)}.{pick(SUFFIXES, i, label, 'suffix')}"
            about = label == 0 and i % 4 == 1
            words = bad_words if about or (label and not bad_host) else GOOD
            path = pick(TOPIC_PATHS if about else BAD_PATHS if words is bad_words else PATHS, i, label, "path").format(n=crc32(repr((i, label)).encode()) % 9000, w=pick(words, i, label, "w"), v=pick(BOTH, i, label, "v"))
            rows.append((f"https://{host}{path}", float(label), i % HELD_OUT == 0))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label double, held_out boolean").coalesce(1)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Both empty for null or without ://."""
    rest = F.when(F.locate("://", "url") > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    parts = [F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)\A([^/?#]*)([^?#]*)", i) for i in (1, 2)]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path")]
    return pages.select(*keep, F.translate(parts[0], upper, upper.lower()).alias("host"), parts[1].alias("path"))


def _first_fit(rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits (of equally long ones the last), else null. The list is short: it becomes one expression."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        host = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        out = F.when(host & F.col("path").startswith(rule.path), F.lit(value(rule))).otherwise(out)
    return out


def train(labelled: DataFrame) -> PipelineModel:
    """Hashed character n-grams of host and path, and a ridge logistic regression on them."""
    stages: list = []
    for part in ("host", "path"):
        stages.append(RegexTokenizer(inputCol=f"own_{part}", outputCol=f"{part}_chars", pattern="(?s).", gaps=False))
        for n in LENGTHS:
            stages.append(NGram(n=n, inputCol=f"{part}_chars", outputCol=f"{part}_{n}"))
            stages.append(HashingTF(numFeatures=DIMENSIONS, inputCol=f"{part}_{n}", outputCol=f"{part}_{n}_hashed"))
    stages.append(VectorAssembler(inputCols=[f"{part}_{n}_hashed" for part in ("host", "path") for n in LENGTHS], outputCol="hashed"))
    stages.append(LogisticRegression(featuresCol="hashed", labelCol="label", regParam=RIDGE, maxIter=30, standardization=False))
    return Pipeline(stages=stages).fit(_framed(with_host_and_path(labelled)))


def _framed(df: DataFrame) -> DataFrame:
    """Host and path between marks, so that n-grams know beginning and end."""
    return df.withColumns({f"own_{p}": F.concat(F.lit("^^"), F.col(p), F.lit("$$")) for p in ("host", "path")})


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: PipelineModel | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and block_probability (the model's, whatever a rule says).

    Null and malformed URLs have an empty host and path, which no rule fits, and are allowed, as there is nothing to
    judge; columns named as a result are replaced; repeated rows are judged each; an empty table gives no rows.
    """
    results = ("rule", "verdict", "block_probability")
    parsed = with_host_and_path(pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in results]))
    model = model or train(labelled_urls(pages.sparkSession).where("NOT held_out"))
    scored = model.transform(_framed(parsed.select(F.struct(*[F.col(f"`{c}`") for c in parsed.columns]).alias("row"), "host", "path")))
    probability = vector_to_array("probability")[1]
    empty = (F.col("host") == "") & (F.col("path") == "")
    own = F.when(~empty & (probability >= BLOCK_FROM), "block").otherwise("allow")
    return scored.select("row.*", _first_fit(rules, lambda r: r.text).alias("rule"), F.coalesce(_first_fit(rules, lambda r: r.verdict), own).alias("verdict"), probability.alias("block_probability"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")
