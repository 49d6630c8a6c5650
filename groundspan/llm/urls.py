"""8. URL filter: logistic regression on hashed character n-grams of host and path.

Trained in numpy from a small labelled table of invented URLs (labelled), none of whose hosts and paths is in the given pages; all of a URL is scored, by one pass
over the bytes of a batch. The weights are of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import _RANDOM, map_batches, mix, steps, text_bytes

LENGTHS, BUCKETS, SEED = (3, 4, 5), 1 << 15, 3
EPOCHS, RATE, PENALTY = 300, 0.05, 1e-3
THRESHOLD = 0.5

_UNWANTED_HOSTS = """buy-pills-online pillshop pharma-discount rx-meds-now viagra-direct cialis-store discount-pills generic-pills pills4u diet-pills-shop
cheap-meds cheap-viagra cheapest-rolex casino-royal online-casino lucky-casino casino-bonus casinoslots best-casino-games slots-jackpot poker-bonus pokerroom
roulette-wins win-big-money win-prizes-now instant-win bet365-bonus sport-bets bets-now betting-tips livebets bigbets-online free-spins free-iphones free-cash-now
jackpot-spins adult-videos adult-dating adultcams xxx-tube xxxmovies sexcam-live hot-singles porn-hd freeporn nude-cams escort-girls link-farm linkfarm-seo seo-spam
spam-mailer spamlinks bulk-spam-sender backlinks-farm content-farm-net adserver-clicks ads-network adsclick banner-ads popup-ads track-ads click-tracker
ad-tracking-pixel trackers-net tracking-beacon malware-download free-cracks warez-keygen crack-serials torrent-cracks payday-loans quick-cash-loan fast-loans-online
replica-watches fake-rolex-shop free-ringtones prize-winner-claim crypto-doubler bitcoin-giveaway get-rich-quick miracle-diet weightloss-pills hacked-accounts""".split()
_UNWANTED_PATHS = "/buy-now /free-bonus?aff=77 /casino/slots /pills/order.php /xxx/gallery /win /click?track=1 /promo/bets /deal?subid=9 /landing/claim-prize".split()
_WANTED_HOSTS = """gardenjournal citylibrary openmaps northriver museum-guide cookingnotes treehouse weatherdesk studentnews historyroom shortstories
nation-review gastation readingcircle mathforum birdwatch hillside harbourtown bookshelf filmcritic sciencedaily localnews healthcouncil university cityhall
park-trails physicsnotes musiclessons photoclub localtheatre thinking-aloud mother-tongue weatherstation railwaypages astronomy chessclub knitting farmersmarket
birdtracks farmhouse winery betterhomes trackandfield adaptation winterland castle-tours marketing-research sportsclub lovepoetry softwaredocs linuxguide
essays-online freelance-writers freshwater-fish cheapside-history pillow-fort pillarbox alphabets tibetan-art spamalot-theatre addresses-of-note adultlearning
adult-education tracking-wildlife trackmaintenance window-makers winding-roads northern-lights southern-cooking river-walks mountain-weather old-bridges
stonemasons letterpress bakery-school village-fete choir-practice streetmaps opendata-portal parliament-watch lawreports court-records patent-search
veterinary-clinic dental-practice nursing-notes algebra-tutor geometry-lab chemistry-set biology-dept archive-of-letters oralhistories genealogy-society
cyclingroutes sailing-club rowing-association hiking-diary campsite-finder trainspotting bus-timetables airport-guide ferry-times translation-notes
grammar-corner dictionary-of-places etymology journal-of-soils statistics-office survey-methods compiler-notes databasedesign kernel-hackers webstandards
painting-studio sculpture-park ceramics-guild opera-house orchestra jazz-evenings folk-festival poetry-review novelists playwrights recipes-from-home
haus-und-garten stadtbibliothek wanderwege kochbuch nachrichten-heute maison-et-jardin bibliotheque-municipale sentiers recettes-simples actualites
casa-y-jardin biblioteca-central senderos cocina-facil noticias-locales""".split()
_WANTED_PATHS = "/about /2019/05/notes.html /articles/spring /wiki/River /forum/thread/88 /contact /archive?year=1999 /category/books /team/members /events/calendar.ics".split()
#: What says nothing, as both kinds of hosts have it.
_NEUTRAL_PATHS = "/ /index.html /p/12345 /news/item-77.html /post?id=31 /blog/2021/11/03/update /a/b/c /search?q=word&sort=date /s/xk29 /page-4/ /view.php?n=8&lang=en /home#main /item/550/detail /feed.xml /topics/9?from=mail /docs/v2/start".split()
_ENDS = ("com", "net", "org", "info", "edu", "co.uk", "de", "fr")
_STARTS = ("", "www.", "", "en.", "shop.", "news.", "")


@cache
def labelled() -> list[tuple[str, int]]:
    """The labelled URLs; 1 is unwanted. Each host comes with some of the paths, beginnings and ends."""
    out = []
    for hosts, paths, label in ((_UNWANTED_HOSTS, _UNWANTED_PATHS, 1), (_WANTED_HOSTS, _WANTED_PATHS, 0)):
        for i, host in enumerate(hosts):
            for k in range(4):
                path = _NEUTRAL_PATHS[(5 * i + 3 * k) % len(_NEUTRAL_PATHS)] if k else paths[i % len(paths)]
                out.append((f"http{'s' * (k % 2)}://{_STARTS[(i + 2 * k) % len(_STARTS)]}{host}.{_ENDS[(i + 3 * k) % len(_ENDS)]}{path}", label))
    return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path with query, both lower case; a text that isn't a URL is a path."""
    try:
        found = urlsplit((url or "").strip().lower())
        host = found.netloc.rpartition("@")[2].partition(":")[0]
    except ValueError:
        return "", (url or "").lower()
    return host, found.path + ("?" + found.query if found.query else "")


def features(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the URL, bucket) of all n-grams; host and path have buckets of their own."""
    texts = [x for url in urls for host, path in [parts(url)] for x in (f"^{host}$" if host else "", f"{path}$" if path.strip("/") else "")]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    values = _RANDOM[data]
    numbers, buckets = [], []
    for n in LENGTHS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + values[k : len(data) - n + 1 + k]
        own = text[: len(h)] == text[n - 1 :]
        of = text[: len(h)][own]
        numbers.append(of // 2)
        buckets.append((mix(h[own] + (of % 2 + 2 * n).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64))
    return (np.concatenate(numbers), np.concatenate(buckets)) if numbers else (np.zeros(0, np.int64),) * 2


def predict(urls: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    number, bucket = features(urls)
    count = np.maximum(1, np.bincount(number, minlength=len(urls)))
    return 1 / (1 + np.exp(-(np.bincount(number, weights[bucket], len(urls)) / np.sqrt(count) + bias)))


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam on the whole table."""
    urls, y = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    number, bucket = features(urls)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(number, minlength=len(urls))))
    weights, bias = np.zeros(BUCKETS), 0.0
    mean, square, mean_b, square_b = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(number, weights[bucket], len(urls)) * scale + bias)))
        d = (p - y) / len(y)
        g, g_b = np.bincount(bucket, (d * scale)[number], BUCKETS) + PENALTY * weights / len(y), d.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        mean_b, square_b = 0.9 * mean_b + 0.1 * g_b, 0.99 * square_b + 0.01 * g_b * g_b
        weights = weights - RATE * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        bias -= RATE * mean_b / (1 - 0.9**t) / (np.sqrt(square_b / (1 - 0.99**t)) + 1e-8)
    return weights, bias


@cache
def fitted() -> tuple[np.ndarray, float]:
    return fit(labelled())


def filter_urls(pages: DataFrame) -> DataFrame:
    """pages(url, ...) with url_score (0 to 1) and url_blocked (THRESHOLD or more).

    No shuffle. A null URL has null results; an empty one, or one without host and path, scores by the bias alone. Very long URLs
    are read whole; a score that equals THRESHOLD blocks. Repeated rows score alike; an empty table gives no rows; columns of pages that have the name of a result are replaced, others kept.
    """
    new = T.StructType().add("url_score", T.DoubleType()).add("url_blocked", T.BooleanType())
    kept = pages.drop(*new.names)
    shared = pages.sparkSession.sparkContext.broadcast(fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "url"):
                urls = part.column("url")
                score = predict(urls.to_pylist(), *shared.value)
                null = urls.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, mask=null), pa.array(score >= THRESHOLD, mask=null)], [*part.schema.names, *new.names])

    return map_batches(kept, run, new)
