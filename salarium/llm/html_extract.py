"""Main text of web pages by a site style tree.

1. The pages of a host are merged: elements of the same container path are
   one node of the host's tree.  A page adds to each of its nodes one
   presentation (the sequence of its child containers, runs as one) and the
   texts below the node.
2. With ``m`` pages at a node, its presentation importance is the entropy of
   the presentations to base ``m``; the importance of its content is one
   less the mean entropy of its texts over the pages, log c / log m for a
   text that ``c`` pages show.  Their weighted sum is the importance of the
   node: near 0 for what a site repeats, near 1 for what each page has anew.
3. From each page, branches whose nodes are all of low importance go, and so
   do containers that their markup names as menu, header, footer, sidebar,
   notice, advert, form or comments; of the rest, the blocks inside article or main elements stay
   if there are any.  A class, an id or a form alone rules out no html, body, main or article element
   and no container of most of the text (``page_tree.lift``).

Copies and near copies of a page on one host are one page of its tree, so
that a group of copies does not make an article look repeated.  Near copies
are pages whose clear text shares all hashes of a min-wise key; a few changed
words may leave some of a large group apart.  Counts are aggregated before they are shuffled, so a host with most pages
spreads over all tasks.  The low nodes go to the pages as a broadcast if
they are at most ``BROADCAST_NODES``, by a join on the page's content
otherwise; both give the same result.

Defined results: a null html is an empty page, its text is empty; a null or
odd url belongs to the host ''; a node that fewer than ``LEAST_PAGES`` pages
of a host share is judged by its markup alone; if everything would go, the
blocks that the markup does not rule out stay, or those with the fewest
marks around them; repeated pages and null ids
each keep a row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.llm.common import ref
from salarium.llm.page_tree import Page, parse
from salarium.session import materialize

LEAST_PAGES = 5
#: Nodes below this importance are boilerplate.
LEAST_IMPORTANCE = 0.55
#: Weight of the content in the importance of a node.
CONTENT_WEIGHT = 0.9
BROADCAST_NODES = 200_000
#: Keys by which near copies meet, and the min-wise hashes in each.
ROUNDS, MINIMA = 2, 6
MIX = np.random.default_rng(7).integers(1 << 62, size=ROUNDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def features(page: Page) -> set[tuple[str, int, int]]:
    """(node, kind, hash): kind 0 presentations, kind 1 texts below the node."""
    children: dict[str, list[str]] = {}
    for path, parent in page.containers:
        children.setdefault(path, [])
        seen = children.setdefault(parent, [])
        child = path[len(parent):]
        if not seen or seen[-1] != child:
            seen.append(child)
    out = {(node, 0, xxhash.xxh64_intdigest("".join(seen)) >> 1) for node, seen in children.items() if node}
    for block in page.blocks:
        value = xxhash.xxh64_intdigest(block.text) >> 1
        node = block.path
        while node:
            out.add((node, 1, value))
            node = node[:node.rfind("/")]
    return out


def sketches(text: str) -> list[bytes]:
    """``ROUNDS`` keys of ``MINIMA`` min-wise hashes of word triples each:
    a text with few changes mostly shares one of the keys."""
    words = text.split()
    triples = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, triples), np.uint64, len(triples))
    least = np.array([(h * m).min() for m in MIX])
    return [least[r * MINIMA:(r + 1) * MINIMA].tobytes() for r in range(ROUNDS)]


def different_pages(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value) of the features of the pages of (host,
    html), copies and near copies of a page once for each host: of pages
    that share a key the one of the smallest hash stays, in each round."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for source in part.column(1):
                    html = source.as_py() or ""
                    page = parse(html)
                    tree = zlib.compress(json.dumps(sorted(features(page))).encode(), 1)
                    rows.append((xxhash.xxh64_intdigest(html) >> 1, tree, *sketches(article(page, set()))))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()),
                                                  *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    keys = [f"key{r}" for r in range(ROUNDS)]
    names = ["host", "page", "tree", *keys]
    rows = pages.select("host", "html").mapInArrow(packed, "host string, page long, tree binary, " + ", ".join(f"{k} binary" for k in keys))
    for key in keys:
        rest = [n for n in names if n not in ("host", key)]
        rows = rows.groupBy("host", key).agg(F.min(F.struct(*rest)).alias("one")).select("host", key, "one.*")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, tree in zip(b.column(0).to_pylist(), b.column(1)):
                nodes, kinds, values = list(zip(*json.loads(zlib.decompress(tree.as_py())))) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(nodes), pa.string()), pa.array(nodes, pa.string()),
                                                  pa.array(kinds, pa.int32()), pa.array(values, pa.int64())], ["host", "node", "kind", "value"])

    return rows.select("host", "tree").mapInArrow(unpacked, "host string, node string, kind int, value long")


def site_tree(pages: DataFrame, copies: bool = True) -> DataFrame:
    """(host, node, pages, importance) of every node of every host's tree,
    from (host, html); without ``copies`` each group of copies and near
    copies of a page on a host is one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                hosts, nodes, kinds, values = [], [], [], []
                for host, source in zip(b.column(0)[at:at + 256], b.column(1)[at:at + 256]):
                    for node, kind, value in features(parse(source.as_py() or "")):
                        hosts.append(host.as_py())
                        nodes.append(node)
                        kinds.append(kind)
                        values.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.string()),
                                                  pa.array(kinds, pa.int32()), pa.array(values, pa.int64())],
                                                 ["host", "node", "kind", "value"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, node string, kind int, value long") if copies else different_pages(pages)
    c = F.col("c").cast("double")
    counts = seen.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    shown, text = F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(shown, c)).alias("pages"), F.sum(F.when(shown, c * F.log(c))).alias("shown"),
        F.sum(F.when(text, c)).alias("texts"), F.sum(F.when(text, c * F.log(c))).alias("spread"))
    m = F.col("pages")
    base = F.log(m)
    presentation = F.when(m > 1, (base - F.col("shown") / m) / base).otherwise(1.0)
    content = F.when((m > 1) & (F.col("texts") > 0), 1 - F.col("spread") / F.col("texts") / base).otherwise(
        F.when(m > 1, 0.0).otherwise(1.0))
    return nodes.select("host", "node", m.cast("long").alias("pages"),
                        ((1 - CONTENT_WEIGHT) * presentation + CONTENT_WEIGHT * content).alias("importance"))


def noisy_nodes(tree: DataFrame) -> DataFrame:
    """(host, node) of the nodes that are of low importance themselves and
    in all their branches."""
    tree = materialize(tree)
    low = (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    holds = tree.where(~low).select("host", F.explode(above).alias("node")).distinct()
    return tree.where(low).select("host", "node").join(holds, ["host", "node"], "left_anti")


def article(page: Page, low: set[str]) -> str:
    """The blocks outside boilerplate and low branches, joined."""

    def is_low(path: str) -> bool:
        while path:
            if path in low:
                return True
            path = path[:path.rfind("/")]
        return False

    # nothing clear: the blocks of the fewest marks
    least = min(((b.hard, b.named) for b in page.blocks), default=(0, 0))
    clear = [b for b in page.blocks if (b.hard, b.named) == least]
    kept = [b for b in clear if not is_low(b.path)] if low else clear
    kept = kept or clear
    # article and main elements go first only where they hold most of what the
    # tree keeps: teasers may be such elements too
    inside = [b for b in kept if b.main]
    most = 2 * sum(len(b.text) for b in inside) > sum(len(b.text) for b in kept)
    return " ".join(b.text for b in (inside if most else kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    rows = pages.select(ref(pages, id_col).alias("page_id"), ref(pages, url_col).cast("string").alias("url"),
                        host_of(ref(pages, url_col).cast("string")).alias("host"),
                        ref(pages, html_col).cast("string").alias("html"))
    id_kind = rows.schema["page_id"].dataType.simpleString()
    low = materialize(noisy_nodes(site_tree(rows, copies=False)))
    out_kind = f"page_id {id_kind}, url string, text string"

    def text_rows(b: pa.RecordBatch, low_of) -> pa.RecordBatch:
        texts = [article(parse(s.as_py() or ""), low_of(i)) for i, s in enumerate(b.column("html"))]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    if low.count() <= broadcast_nodes:
        found: dict[str, set[str]] = {}
        for r in low.collect():  # at most ``broadcast_nodes`` rows
            found.setdefault(r["host"], set()).add(r["node"])
        shared = pages.sparkSession.sparkContext.broadcast(found)

        def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hosts = b.column("host").to_pylist()
                yield text_rows(b, lambda i: shared.value.get(hosts[i], set()))

        out = rows.select("page_id", "url", "host", "html").mapInArrow(by_host, out_kind)
    else:
        key = F.md5(F.concat(F.col("host"), F.lit("|"), F.coalesce("html", F.lit(""))))
        keyed = rows.withColumn("key", key)

        def own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, host, source in zip(*(b.column(c).to_pylist() for c in ("key", "host", "html"))):
                    nodes = sorted({path for path, _ in parse(source or "").containers})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes), pa.string()), pa.array([host] * len(nodes), pa.string()),
                                                      pa.array(nodes, pa.string())], ["key", "host", "node"])

        own = keyed.select("key", "host", "html").mapInArrow(own_nodes, "key string, host string, node string")
        own = own.join(low, ["host", "node"]).groupBy(F.col("key").alias("k")).agg(F.collect_set("node").alias("low"))

        def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lows = b.column("low").to_pylist()
                yield text_rows(b, lambda i: set(lows[i] or ()))

        joined = keyed.join(own, F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "low")
        out = joined.mapInArrow(by_row, out_kind)
    return out.withColumn("n_chars", F.length("text").cast("long"))
