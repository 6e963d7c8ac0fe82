"""URL filter: rules on host and path, then logistic regression on hashed character n-grams.

The classifier is trained on a small labelled URL table (by default BLOCKED and ALLOWED below, under reserved domains; the
tests hold others back), with the JVM's own feature hashing and optimiser; scoring is one pass without a shuffle. The
model is ``2 ** bits`` numbers at any input size.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: more rules than this are joined by host
MOST_RULES = 1000
SIZES = (3, 4, 5)
BITS = 14
#: rows that training reads at most
MOST_LABELLED = 20_000

#: labelled URLs to learn from, fixed
BLOCKED = """
https://www.lucky-spin-casino.example.com/slots/free-spins?ref=91
http://casino-royal-online.example.net/bonus/welcome.html
https://play.bigwin-slots.example/jackpot/daily
https://m.pokerstake.example.org/tables/holdem/join
http://best-poker-bonus.example.com/en/review-12.html
https://sportbet24.example.net/live/odds/football
https://www.betting-tips-vip.example.com/free-bets
https://lottery-results-winner.example.org/claim/prize
http://online-gambling-guide.example.com/roulette/how-to-win
https://roulette-and-blackjack.example.net/casino/no-deposit
https://www.cheap-pills-store.example.com/buy/without-prescription
http://pharma-discount.example.net/viagra/order.php?id=3
https://meds4less.example.org/catalog/weight-loss-pills
https://slim-fast-diet.example.com/miracle-pills
http://generic-cialis-shop.example.com/cheap/20mg
https://www.onlinepharmacy-no-rx.example/tabs/order-now
https://xxx-videos-free.example.com/watch/1182
http://adult-webcams.example.net/live/models
https://www.hot-dating-tonight.example.org/singles/near-you
https://sexy-escorts.example.com/city/listing
http://porn-tube-hd.example.net/category/12?page=4
https://adult-dating-club.example.com/signup/free
https://freexxxpics.example/gallery/33.html
https://spam-mailer.example.com/bulk/email-list
http://seo-backlinks-cheap.example.net/buy-links/1000
https://linkfarm-directory.example.org/add/url.php
https://www.article-spinner.example.com/spun/content-77
http://spamblog.example.net/tag/buy-cheap/page/9
https://ads.clicktracker.example.com/banner.gif?cid=8812
http://adserver.popunder.example.net/serve/click?zone=4
https://track.affiliate-network.example.com/redirect?offer=27&aff=5
https://pixel.adtracking.example.org/imp?x=1
http://banners.ad-exchange.example.com/adclick/99
https://pop.promo-ads.example.net/landing/popup.html
https://doubleclicks.example.com/ads/serve?slot=top
https://free-iphone-winner.example.com/survey/claim-now
http://you-won-a-prize.example.net/congratulations.html
https://www.gift-card-generator.example.org/free/codes
https://win-cash-today.example.com/spin-and-win
http://freegiveaway.example.net/claim/reward?id=1
https://payday-loans-fast.example.com/apply/no-credit-check
http://quick-cash-advance.example.net/loan/instant-approval
https://bad-credit-loans.example.org/approved
https://www.debt-relief-now.example.com/cheap-loans
https://crypto-doubler.example.com/send-1-get-2
http://bitcoin-invest-profit.example.net/guaranteed/returns
https://forex-robot-millionaire.example.com/earn/daily
https://airdrop-claim-wallet.example/connect
https://make-money-home.example.org/earn-5000-a-week
http://get-rich-quick.example.com/secret/system.html
https://replica-watches-outlet.example.com/rolex/cheap
http://fake-designer-bags.example.net/replica/sale
https://www.cheap-nike-outlet.example.org/discount/90-off
https://warez-downloads.example.com/full/crack/photo-editor
http://keygen-serials.example.net/serial/office.html
https://torrent-movies-hd.example.org/download/cam-rip
https://cracked-apps.example.com/apk/mod-unlimited
https://free-movie-streams.example.net/watch-online/full-hd
http://nulled-scripts.example.com/download/theme-nulled.zip
https://login-verify-account.example.com/secure/update/password
http://paypa1-security.example.net/signin/confirm.php
https://bank-alert-verify.example.org/customer/login.html?session=8
https://apple-id-locked.example.com/unlock/verify
http://webmail-quota-full.example.net/owa/validate
https://malware-cleaner-pro.example.com/scan/your-pc-is-infected
http://antivirus-alert.example.net/download/setup.exe
https://driver-update-free.example.org/install/toolbar
https://flash-player-update.example.com/get/player.exe
http://hack-tool-online.example.net/coins/generator
https://cheats-unlimited-coins.example.com/hack/no-survey
https://www.psychic-love-spells.example.org/order/spell
http://essay-writing-cheap.example.com/buy-essay/24h
https://fake-diploma.example.net/buy/degree-online
https://buy-followers-likes.example.com/instant/1000
http://proxy-unblock.example.net/browse.php?u=aHR0
https://weight-loss-miracle.example.org/belly-fat-trick
https://hairgrowth-miracle.example.com/order-trial/free
http://clickbait-viral.example.net/you-wont-believe/17
https://bet365-mirror.example.com/casino/register
http://win-lotto-numbers.example.net/system/jackpot
https://escort-agency-vip.example.org/girls
https://pills-online-24.example.net/cart/add?sku=7
""".split()
ALLOWED = """
https://www.citylibrary.example.org/events/2023/reading-hour
http://news.northvalley.example.com/politics/council-votes-on-budget
https://www.weather-service.example.net/forecast/week
https://recipes.kitchenbook.example.com/soup/lentil-with-cumin.html
http://gardening.example.org/articles/pruning-roses
https://university.example.com/physics/courses/quantum-mechanics
https://museum.example.org/collections/bronze-age/object-118
http://www.townschool.example.net/calendar/term-dates.html
https://blog.hikingtrails.example.com/2021/06/lake-loop
https://docs.example.org/manual/install/linux
http://wiki.example.net/index.php?title=Photosynthesis
https://forum.woodworkers.example.com/thread/8812/dovetail-joints
https://journal.example.org/volume-12/issue-3/article-4
http://archive.example.com/1999/letters/editor.html
https://www.healthservice.example.org/conditions/asthma
https://radio.example.net/programmes/morning-concert
http://orchestra.example.com/season/tickets/brahms
https://www.mountain-rescue.example.org/reports/2020
https://chess-club.example.com/games/annotated/27
http://poetry.example.net/poets/anthology/winter
https://astronomy.example.org/observing/moon-phases
https://www.cyclingmap.example.com/routes/river-path
http://sailing.example.net/knots/bowline.html
https://birdwatch.example.org/species/kingfisher
https://theatre.example.com/plays/autumn/review
http://cityhall.example.net/planning/applications/552
https://www.parliament.example.org/bills/2022/17/second-reading
https://statistics.example.com/tables/population-by-age
http://maps.example.net/walks/coast/3
https://opensource.example.org/projects/editor/readme
https://developers.example.com/api/reference/strings
http://mathnotes.example.net/algebra/groups/lemma-4.html
https://language-learning.example.org/grammar/verbs
https://www.bookreview.example.com/novels/the-long-river
http://historysociety.example.net/papers/market-town
https://genealogy.example.org/parish/records/1841
https://www.farmersmarket.example.com/stalls/vegetables
http://bakery.example.net/bread/sourdough-basics
https://knitting.example.org/patterns/scarf
https://photography.example.com/guides/exposure
http://www.village-news.example.net/notices/footbridge-repair
https://railway.example.org/timetable/north-line
https://aquarium.example.com/visit/opening-hours
http://botanic-garden.example.net/plants/fern-house
https://www.charity.example.org/report/annual/2019
https://science.example.com/biology/cells/mitosis
http://geology.example.net/rocks/basalt
https://climate.example.org/data/rainfall/monthly
https://www.hospital.example.com/departments/cardiology
http://philosophy.example.net/essays/on-memory
https://sports.example.org/hockey/results/round-5
https://athletics.example.com/club/training/tuesday
http://www.football-club.example.net/fixtures/under-12
https://travel.example.org/guides/old-town-walk
https://hostel.example.com/rooms/booking-info
http://ferry.example.net/timetable/summer
https://courts.example.org/decisions/2018/442
https://lawnotes.example.com/contract/offer-and-acceptance
http://economics.example.net/lectures/trade
https://www.music-school.example.org/lessons/violin
https://film-archive.example.com/silent/restoration
http://painting.example.net/technique/watercolour
https://architecture.example.org/buildings/town-hall
https://engineering.example.com/bridges/suspension
http://electronics.example.net/kits/radio-receiver
https://software.example.org/release-notes/4.2
https://mailinglist.example.com/archive/2004-march/0192.html
http://community.example.net/questions/4411/how-to-sort-a-list
https://dictionary.example.org/word/serendipity
https://encyclopedia.example.com/rivers/danube
http://www.elementary-school.example.net/class-3/reading-list
https://kindergarten.example.org/menu/week-14
https://observatory.example.com/lectures/public
http://zoo.example.net/animals/otter
https://national-park.example.org/trails/waterfall
https://fishing.example.com/rivers/seasons
http://beekeeping.example.net/hives/spring-check
https://www.pottery.example.org/glazes/celadon
https://newsletter.example.com/issue/88/interview
http://minutes.example.net/parish-council/2017-05
https://tea-house.example.org/menu/green-teas
https://storytelling.example.com/tales/fox-and-crane
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(found(1), UPPER, LOWER), found(2)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for BLOCKED, 0 for ALLOWED and for the empty URL."""
    return spark.createDataFrame([*((u, 1) for u in BLOCKED), *((u, 0) for u in ALLOWED), ("", 0)], "url string, label int")


def ngrams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """Distinct character n-grams of ``^text$``, in time proportional to the length."""
    def of_size(chars: Column, k: int) -> Column:
        n = F.size(chars)
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))

    def over(chars: Column) -> Column:
        return F.array_distinct(F.concat(*[of_size(chars, k) for k in sizes]))

    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    return F.get(F.transform(F.array(chars), over), 0)


def _features(df: DataFrame, text: Column, bits: int) -> DataFrame:
    hashed = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=1 << bits, binary=True)
    return hashed.transform(df.withColumn("_grams", ngrams(text))).drop("_grams")


def train(labelled: DataFrame, bits: int = BITS) -> LogisticRegressionModel:
    """Fits on ``labelled`` (url, label), at most MOST_LABELLED rows by code point; null labels are skipped."""
    rows = labelled.where("label is not null").orderBy("url", "label").limit(MOST_LABELLED).coalesce(1)
    host, path = host_and_path(F.col("url"))
    data = _features(rows, F.concat(host, path), bits).select(F.col("_features").alias("features"), F.col("label").cast("double").alias("label"))
    data = data.cache()
    try:
        return LogisticRegression(maxIter=60, regParam=1e-3, standardization=False).fit(data)
    finally:
        data.unpersist()


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits (action and text); of equally long ones a block, then the first by code point."""
    best = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def with_rule(df: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Adds ``_rule`` (action, rule) to rows with host and path. Up to MOST_RULES rules are written into the plan; of more,
    every suffix of the host that begins a label is looked up in a table of the rules by host, whatever their number."""
    if len(rules) <= MOST_RULES:
        return df.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    table = df.sparkSession.createDataFrame([(a, h, p) for a, h, p in rules], "_action string, _h string, _p string")
    by_host = F.broadcast(table.groupBy("_h").agg(F.collect_set(F.struct("_action", "_p")).alias("_rules")))  # the caller's list
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "urls")
    pairs = df.select("_row", "path", F.explode(F.array_distinct(suffixes)).alias("_h")).join(by_host, "_h").select("_row", "path", "_h", F.explode("_rules").alias("_r"))
    text = F.concat("_h", F.col("_r._p"))
    # the longest; of equal ones a block; then the first by code point
    order = F.struct(F.length(text), F.col("_r._action") == "block", F.transform(F.split(text, ""), lambda c: -F.ascii(c)))
    best = pairs.where(F.col("path").startswith(F.col("_r._p"))).groupBy("_row").agg(F.max_by(F.struct(F.col("_r._action").alias("action"), text.alias("rule")), order).alias("_rule"))
    return df.join(best, "_row", "left").drop("_row")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, bits: int = BITS, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score of every row: the rule's verdict, else block where the score is over 0.5.

    Null and malformed URLs have an empty host and path and get the method's verdict; repeated rows are judged alike;
    an empty table gives no rows; other columns are not read.
    """
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession), bits)
    host, path = host_and_path(F.col("_url"))
    out = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", host.alias("host"), path.alias("path"))
    model.setFeaturesCol("_features").setProbabilityCol("_probability").setPredictionCol("").setRawPredictionCol("")
    out = model.transform(_features(out, F.concat("host", "path"), bits)).withColumn("score", vector_to_array("_probability")[1])
    out = with_rule(out, rules)
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
