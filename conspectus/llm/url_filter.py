"""URL filters: rules on hosts and paths first, then a weighted vocabulary found by an Aho-Corasick automaton.

The vocabulary is looked for in the whole url, query and fragment included, with A-Z lower-cased. A term counts where
both its ends are boundaries (the next character is no ASCII letter or digit). One strict term, or distinct soft terms
whose weights add up to 1, reject the url: a telling term weighs two thirds and needs one more of any kind, a common one
a third and needs two.
Nulls, empty urls and those without "://" have an empty host and path and no rule; the vocabulary judges what text there
is, very long ones in one pass. Repeated rows are judged each by itself, an empty table gives no rows, and only the id and
the url are read, so that other columns, of any name, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: One hit rejects.
STRICT = """adult bdsm blackjack camgirl camgirls casino casinos cialis escort escorts gambling gangbang hardcore hentai hookup
hookups keygen levitra malware milf nsfw nude nudes onlyfans phishing porn porno pornhub pornos roulette scam scams sexcam
sportsbook spam tramadol viagra warez webcamsex xanax xvideos xxx""".split()
#: Terms that tell much, and those that are common in other urls as well.
TELLING = """baccarat bet bets betting bingo bookie cheats crack cracked cracks dating drugs erotic fetish jackpot lottery lotto
nulled payday pharmacy pill pills poker sex sexy singles slot slots steroids stream-free torrent torrents unblocked winner
winners""".split()
COMMON = """ad ads affiliate affiliates bonus bonuses cash cheap cheapest click clickbait coupon coupons credit deal deals discount
download earn exclusive fast forex free gift gifts girls hot instant jackpots loan loans lucky money offer offers online
popup prize prizes profit promo promos quick replica rich survey surveys track tracker tracking trial vip win""".split()
#: Weights of soft terms, in thirds; THIRDS of them in distinct terms reject.
THIRDS = 3
SOFT = dict.fromkeys(COMMON, 1) | dict.fromkeys(TELLING, 2)
#: Rules of host/path and verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    if rest[:1] == "/":
        cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
        return host.translate(_LOWER), rest[:cut]
    return host.translate(_LOWER), ""


class Rules:
    """Finds the longest rule that fits by walking up the host's suffixes."""

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((f"/{path}", rule, verdict))

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        suffix = host
        while suffix:
            for start, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            suffix = suffix.partition(".")[2]
        return best


class Vocabulary:
    def __init__(self, strict: Iterable[str], soft: dict[str, int], reject_at: int) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for term, weight in {**soft, **dict.fromkeys(strict, reject_at)}.items():
            self.find.add_word(term, (term, weight))
        if len(self.find):
            self.find.make_automaton()

    def hits(self, text: str) -> dict[str, int]:
        """Weights of the distinct terms that stand between boundaries."""
        found: dict[str, int] = {}
        if not len(self.find):
            return found
        for end, (term, weight) in self.find.iter(text):
            start = end - len(term)
            around = text[max(start, 0) : start + 1], text[end + 1 : end + 2]
            if not any(c.isascii() and c.isalnum() for c in around):
                found[term] = weight
        return found


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, strict: Iterable[str] = STRICT, soft: dict[str, int] | None = None, reject_at: int = THIRDS) -> DataFrame:
    """Rows (id, host, path, rule, verdict, terms, weight); a narrow scan of two columns, no shuffle."""
    small_batches(pages.sparkSession, 2048)
    rules, strict, soft = tuple(rules), tuple(strict), dict(SOFT if soft is None else soft)
    of_id = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, words = Rules(rules), Vocabulary(strict, soft, reject_at)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "terms", "weight")}
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                fits = by_rule.of(host, path)
                hits = words.hits((url or "").translate(_LOWER))
                weight = sum(hits.values())
                row = host, path, fits and fits[0], fits[1] if fits else "block" if weight >= reject_at else "allow", sorted(hits), weight
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["id", *out])

    found = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    return found.mapInArrow(judge, f"id {of_id}, host string, path string, rule string, verdict string, terms array<string>, weight bigint").withColumnRenamed("id", id_col)
