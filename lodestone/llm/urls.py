"""URL filters: rules by host and path, and logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import mix, ship

DIM = 1 << 14
SIZES = (3, 4, 5)
CUT = 0.6  # scores from which a URL is blocked: wrongly blocking costs more than letting pass
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: A small labelled table: 1 is to be blocked.
LABELLED: tuple[tuple[str, int], ...] = (
    ("http://casino-royal.example/win/free-spins", 1),
    ("https://www.bestcasino.example/bonus", 1),
    ("http://win-jackpot.example/casino", 1),
    ("https://free-bets-online.example/bets/today", 1),
    ("http://sports-bets.example/odds/free", 1),
    ("https://cheap-pills-shop.example/buy/pills", 1),
    ("http://online-pharmacy.example/cheap/viagra", 1),
    ("https://pills4u.example/discount", 1),
    ("http://adult-video.example/xxx/clips", 1),
    ("https://xxx-tube.example/adult", 1),
    ("http://hot-porn.example/free/porn", 1),
    ("https://adult-x-cams.example/live", 1),
    ("http://ads-server.example/track/click?id=1", 1),
    ("https://ads-track-pixel.example/pixel.gif", 1),
    ("http://tracker.ads.example/banner", 1),
    ("https://spam-links.example/link-farm", 1),
    ("http://linkfarm-spam.example/seo/backlinks", 1),
    ("https://cheap-loans.example/payday/loan", 1),
    ("http://payday-loan-fast.example/apply", 1),
    ("https://warez-download.example/crack/keygen", 1),
    ("http://torrent-crack.example/keygen.exe", 1),
    ("https://replica-watches.example/cheap/rolex", 1),
    ("http://weight-loss-miracle.example/buy-now", 1),
    ("https://get-rich-quick.example/win/money", 1),
    ("https://www.university.example/research/papers", 0),
    ("http://library.example/catalogue/1824", 0),
    ("https://docs.project.example/en/latest/index.html", 0),
    ("https://blog.engineer.example/2020/05/notes", 0),
    ("http://news.daily.example/world/article-382.html", 0),
    ("https://en.encyclopedia.example/wiki/History", 0),
    ("https://museum.example/exhibitions/current", 0),
    ("http://www.weather.example/forecast/north", 0),
    ("https://recipes.kitchen.example/soup/leek", 0),
    ("https://m.journal.example/fr/articles/204", 0),
    ("http://www.school.example/en/timetable", 0),
    ("https://health.gov.example/advice/measles", 0),
    ("https://blog.travel.example/es/sevilla", 0),
    ("http://m.forum.example/threads/4711?page=2", 0),
    ("https://www.city.example/de/verkehr", 0),
    ("https://science.example/en/physics/optics", 0),
    ("http://music.example/albums/1973", 0),
    ("https://books.example/fr/romans/12.html", 0),
    ("https://archive.example/en/925?utm_source=feed", 0),
    ("http://garden.example/en/roses#top", 0),
    ("https://www.theatre.example/programme", 0),
    ("https://railway.example/en/stations/40/", 0),
    ("http://chess.example/games/1956", 0),
    ("https://developer.example/reference/http", 0),
    # the same paths on wanted and unwanted hosts, so that hosts decide
    ("http://casino-bonus.site.example/en/731", 1),
    ("https://www.mega-casino.example/fr/12?page=2", 1),
    ("https://blog.cheap-meds.example/en/45.html", 1),
    ("http://m.buy-pills.example/de/8#top", 1),
    ("https://pills-online.example/es/301/", 1),
    ("http://www.spam-mail.example/en/6", 1),
    ("https://spam-network.example/fr/77?utm_source=feed", 1),
    ("http://content-farm.example/en/404.html", 1),
    ("https://m.adult-chat.example/en/91/", 1),
    ("http://www.adult-movies.example/de/250", 1),
    ("https://ads-click.example/en/18?page=2", 1),
    ("http://blog.track-ads.example/es/66", 1),
    ("https://live-bets.example/fr/9.html", 1),
    ("http://m.free-casino.example/en/530#top", 1),
    ("https://win-prizes.example/en/28/", 1),
    ("http://best-bets.example/de/112?utm_source=feed", 1),
    ("https://library.site.example/en/731", 0),
    ("http://www.mountains.example/fr/12?page=2", 0),
    ("http://blog.carpentry.example/en/45.html", 0),
    ("https://m.orchestra.example/de/8#top", 0),
    ("http://gardening.example/es/301/", 0),
    ("https://www.therapist.example/en/6", 0),
    ("http://thunderstorm.example/fr/77?utm_source=feed", 0),
    ("https://history.example/en/404.html", 0),
    ("http://m.station.example/en/91/", 0),
    ("https://www.interest.example/de/250", 0),
    ("http://theory.example/en/18?page=2", 0),
    ("https://blog.northern.example/es/66", 0),
    ("http://translation.example/fr/9.html", 0),
    ("https://m.motion.example/en/530#top", 0),
    ("http://other.example/en/28/", 0),
    ("https://weather.example/de/112?utm_source=feed", 0),
)


def split(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


class Rules:
    """``host/path`` prefixes with their verdicts; the longest that fits wins.

    A rule fits its host and the subdomains of it.  Of equal rules the last one holds.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in dict(rules).items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))
        for mine in self.by_host.values():
            mine.sort(key=lambda r: -len(r[1]))
        self.labels = max((h.count(".") + 1 for h in self.by_host), default=0)  # of the longest host of a rule

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = (None, None), len(host)
        for _ in range(self.labels if host else 0):  # the host's last label, its last two, ...
            at = host.rfind(".", 0, at)
            for prefix, rule, verdict in self.by_host.get(host[at + 1 :], ()):
                if path.startswith(prefix):
                    if best[0] is None or len(rule) > len(best[0]):
                        best = rule, verdict
                    break
            if at < 0:
                break
        return best


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url, feature) for each character n-gram of host and path, which count apart."""
    rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for salt, parts in enumerate((hosts, paths)):
        texts = [b"^" + p.encode("utf-8", "replace") + b"$" for p in parts]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                continue
            number = np.full(n, size + 16 * salt, dtype=np.uint64)
            for j in range(size):
                number = number * np.uint64(0x100000001B3) + data[j : j + n]
            ok = row[:n] == row[size - 1 :]
            rows.append(row[:n][ok])
            found.append((mix(number[ok]) >> np.uint64(50)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


class Regression:
    """Each n-gram of a URL weighs 1 / sqrt(number of its n-grams)."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, f = ngrams(hosts, paths)
        n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        raw = self.bias + np.bincount(row, self.weights[f], minlength=len(hosts)) / np.sqrt(n)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    @classmethod
    def fit(cls, labelled: list[tuple[str, int]], steps: int = 1500, rate: float = 4.0, decay: float = 1e-4) -> Regression:
        """Full-batch gradient descent on the log loss."""
        if not labelled:
            return cls(0.0, np.zeros(DIM))
        hosts, paths = zip(*(split(u) for u, _ in labelled), strict=True)
        y = np.array([float(v) for _, v in labelled])
        row, f = ngrams(list(hosts), list(paths))
        x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        out = cls(0.0, np.zeros(DIM))
        for _ in range(steps):
            slope = (out.scores(list(hosts), list(paths)) - y) / len(y)
            out.weights -= rate * (np.bincount(f, (slope * x)[row], minlength=DIM) + decay * out.weights)
            out.bias -= rate * slope.sum()
        return out


def _judging(shared, column: str, cut: float):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, model = shared.value
        for batch in items:
            if not batch.num_rows:
                continue
            parts = [split(u) for u in batch.column(column).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            score = model.scores(hosts, paths)
            found = [rules.of(h, p) for h, p in parts]
            verdict = [v or ("block" if s >= cut else "allow") for (_, v), s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)],
                names=[*batch.schema.names, "host", "path", "rule", "verdict", "score"],
            )

    return run


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] | tuple[tuple[str, int], ...] = LABELLED, url_col: str = "url", cut: float = CUT) -> DataFrame:
    """pages with host, path, rule (null if none fits), verdict (allow or block) and score (how likely to be blocked).

    Null URLs and those without ``://`` have an empty host and path, which no
    rule fits; the regression judges them as it does any.  Every row is
    judged by itself, repeated ones too.  Very long URLs are judged whole, in time that grows with
    their length.  No rows give no rows.  Columns of the results' names are replaced.
    """
    ship(spark)
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    added = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([*pages.schema.fields, *(T.StructField(n, t) for n, t in added)])
    return pages.mapInArrow(_judging(spark.sparkContext.broadcast((Rules(list(rules)), Regression.fit(list(labelled)))), url_col, cut), schema)
