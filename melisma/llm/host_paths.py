"""Main text by consensus of a host's pages: each page scores its containers, hosts vote on paths, pages are read again."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .html_blocks import ARTICLE_WORDS, CONTAINERS, Page, mark_of, read, text_of
from .url_filter import host_path

#: A path wins on a host with this share of its votes, so at most 1 / SHARE paths win.
SHARE = 0.2
DECAY = 0.5
FAVOURED = 1.5
#: The winners of more hosts are not sent to every task but joined, a host's pages dealt out over SALTS keys.
BROADCAST_HOSTS = 50_000
SALTS = 64


def container_scores(page: Page) -> dict[int, float]:
    """Each container's score: the unlinked characters of its blocks, halved with each container between them."""
    held = [0.0] * len(page.elements)
    for block in page.blocks:
        if not page.elements[block.element].boilerplate:
            held[block.element] += max(0, len(block.text) - 2 * block.linked)
    scores = {}
    for k in range(len(held) - 1, 0, -1):
        e = page.elements[k]
        if held[k] and e.tag in CONTAINERS:
            favoured = e.tag in ("article", "main") or not ARTICLE_WORDS.isdisjoint(e.attributes.get("class", "").lower().replace("-", " ").replace("_", " ").split())
            scores[k] = held[k] * (FAVOURED if favoured else 1)
            held[k] *= DECAY
        held[e.parent] += held[k]
    return scores


def best(page: Page, scores: dict[int, float]) -> int:
    """The container with the best score, the first of ties; the page itself without any."""
    return max(scores, key=lambda e: (scores[e], -e), default=0)


def extract(page: Page, paths: list[str]) -> str:
    """Text of all containers with the first of the winning paths that gives any; else of the page's own best container."""
    for path in paths:
        mark = mark_of(path)
        own = [k for k, e in enumerate(page.elements) if e.mark == mark and e.tag in CONTAINERS]
        found = " ".join(filter(None, (text_of(page, k) for k in own)))
        if found:
            return found
    return text_of(page, best(page, container_scores(page)))


_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _votes(batches):
    for batch in batches:
        votes: dict = defaultdict(float)
        for host, html in zip(batch.column("host"), batch.column("html")):
            page = read(html.as_py())
            scores = container_scores(page)
            if scores:
                votes[host.as_py(), page.path(best(page, scores))] += 1.0
        if votes:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip([*zip(*votes), list(votes.values())], _VOTES)], schema=_VOTES)


def _read_again(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            texts = [extract(read(html), paths or []) for html, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], schema=_TEXTS)


def main_text(pages: DataFrame, share: float = SHARE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null and empty html, and pages of boilerplate only, have empty text. Pages without a host vote and are read together as one
    host. Ties between paths go to the lesser path. Repeated rows stay repeated; empty tables give empty results; further columns
    are dropped. Markup that is cut off ends with the page.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host_path(F.col("url"))[0].alias("host"))
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = durable(votes)
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    ranked = votes.join(total, "host").filter(F.col("votes") >= share * F.col("total"))
    winners = ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))), lambda x: x["path"]).alias("paths"))
    if total.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        found = pages.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    texts = found.select("page_id", "url", "html", "paths").mapInArrow(_read_again, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
