"""HTML as text and links."""

from __future__ import annotations

import html as _html
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags whose content goes, whose ends or starts break lines, and how much postings' fields keep.
DROPPED = "script|style|noscript|template|svg|head"
BLOCKS = "p|div|section|article|header|footer|main|aside|ul|ol|table|tr|h[1-6]|blockquote|pre|form|li|dl|dt|dd"
MOST = 20_000
MOST_LINKS = 41
JOB_PATH = r"(?i)/(?:jobs?|careers?|positions?|openings?|vacanc(?:y|ies)|roles?|opportunit(?:y|ies)|join)(?:/|-|$)"
OTHER_PATH = r"(?i)/(?:saved|login|sign-?in|account|search|alerts?|talent-?community|benefits|culture|life-?at)\b"
ASSET = r"(?i)\.(?:png|jpe?g|gif|svg|webp|pdf|css|js|ico|zip|xml|json)$"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    """Character references, nested up to three deep: Spark has no function for the table of names."""

    def one(s):
        for _ in range(3):
            new = _html.unescape(s)
            if new == s:
                break
            s = new
        return s

    return texts.map(one)


def html_to_text(c: Column, most: int | None = MOST) -> Column:
    """Text of a page: content of scripts and the like goes, blocks break lines, list items get a dash, references are
    resolved, white space collapses, and at most ``most`` characters stay, cut at a paragraph (None: all). Only the references
    leave the JVM."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    for pattern, instead in (
        (r"(?s)<!--.*?(?:-->|$)", ""), (rf"(?is)<({DROPPED})\b[^>]*>.*?(?:</\1\s*>|$)", ""), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<(?:br|hr)\b[^>]*>", "\n"), (rf"(?i)</(?:{BLOCKS})\s*>", "\n"), (r"<[^>]*(?:>|$)", ""),
    ):
        raw = F.regexp_replace(raw, pattern, instead)
    text = _unescape(raw)
    for pattern, instead in ((r"(?U)[^\S\n]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, instead)
    if most is None:
        return text
    cut = F.regexp_replace(F.left(text, F.lit(most)), r"(?s)^(.{10000,})\n\n.*$", "$1")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("\n\n[truncated]")))


def job_links(page: Column, html: Column, most: int | None = MOST_LINKS) -> Column:
    """Links of a page to its own host that look like single postings, in page order, without fragments, distinct, at
    most ``most`` (None: all). Anchors are found in the JVM; only joining relative links is Python's."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))
    joined = _absolute(page, hrefs)
    path = lambda u: F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    good = F.filter(joined, lambda u: path(u).rlike(JOB_PATH) & ~path(u).rlike(OTHER_PATH) & ~path(u).rlike(ASSET) & (F.size(F.filter(F.split(path(u), "/"), lambda x: x != "")) >= 2))
    return F.array_distinct(good) if most is None else F.slice(F.array_distinct(good), 1, most)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute(pages: pd.Series, links: pd.Series) -> pd.Series:
    def one(page, hrefs):
        host, out = urlparse(page or "").netloc.lower(), []
        for h in hrefs if hrefs is not None else ():
            try:
                url = urldefrag(urljoin(page or "", h.strip()))[0].rstrip("/")
                if url.startswith(("http://", "https://")) and urlparse(url).netloc.lower() == host:
                    out.append(url)
            except ValueError:
                pass
        return out

    return pd.Series([one(p, x) for p, x in zip(pages, links)])


def parked(c: Column) -> Column:
    """A page that only says its domain is for sale."""
    return c.rlike(r"(?i)domain\s+(?:name\s+)?(?:is|may\s+be)\s+for\s+sale|buy\s+this\s+domain|sedoparking|parkingcrew|domain\s+parking|this\s+domain\s+is\s+parked")


def decode(body: Column, content_type: Column) -> Column:
    """Bytes as text: by the stated charset, else UTF-8 if valid, else windows-1252."""
    stated = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([\w-]+)", 1))
    latin = F.decode(body, "windows-1252")
    return F.when(stated.isin("iso-8859-1", "latin-1", "windows-1252"), latin).when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(latin)


