"""Text, URL and number helpers as Column -> Column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Drops any Unicode white space at both ends; ``trim`` only drops blanks."""
    return F.regexp_replace(c, _BLANK, "")


def candidate_text(title: Column, content: Column, most: int = 2000) -> Column:
    """Title and content in two lines, stripped, then at most ``most`` characters."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    return F.substring(strip(joined), 1, most)


def profile_text(title: Column, content: Column, most: int = 1000) -> Column:
    """Content is shortened before the join; blank results are null."""
    body = F.substring(F.coalesce(content, F.lit("")), 1, most)
    out = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), body))
    return F.when(out != "", out)


def word_tags(text: Column) -> Column:
    """Maximal word tokens of two or more Han or Latin letters, lower case, each once."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[一-龥a-z]{2,}$")))


def normal_tags(tags: Column) -> Column:
    """Stripped, lower case, blanks dropped; repeats stay."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(t))), lambda t: t.isNotNull() & (t != ""))


_ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&hellip;", "…"), ("&mdash;", "—"), ("&amp;", "&")]


def html_text(html: Column) -> Column:
    """Block ends become line ends, list items dashes; tags go, the usual entities are read."""
    t = F.regexp_replace(html, r"</p>|</li>|<br\s?/?>|</h[1-6]>", "\n")
    t = F.regexp_replace(t, r"<li[^>]*>", "- ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return strip(t)


def file_name(title: Column, most: int = 100) -> Column:
    return F.substring(F.replace(F.regexp_replace(title, r'[\\/*?:"<>|]', ""), F.lit(" "), F.lit("_")), 1, most)


def full_url(href: Column, host: str) -> Column:
    """An absolute https address for absolute, scheme-less and relative references."""
    h = strip(F.coalesce(href, F.lit("")))
    return (
        F.when(h == "", "")
        .when(h.startswith("http://") | h.startswith("https://"), h)
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith(f"/{host}") | h.startswith(host), F.concat(F.lit("https://"), F.regexp_replace(h, "^/+", "")))
        .when(h.startswith("/"), F.concat(F.lit(f"https://{host}"), h))
        .otherwise(F.concat(F.lit(f"https://{host}/"), h))
    )


def url_id(url: Column) -> Column:
    """The last path part, without query or fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/([^/?#]+)/?(?:[?#].*)?$", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/?#]+)", 1)


def time_digits(t: Column) -> Column:
    """All digits of a free-text time as one number; null without any."""
    d = F.regexp_replace(F.coalesce(t, F.lit("")), r"[^0-9]", "")
    return F.when(d != "", d.cast("decimal(38,0)"))


def first_count(text: Column) -> Column:
    """The first whole number of a text, thousands separators aside; 0 without one."""
    d = F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), r"(\d+)", 1)
    return F.coalesce(F.when(d != "", d.cast("bigint")), F.lit(0).cast("bigint"))


def reply_json(text: Column) -> Column:
    """The outermost object of a model's reply, thoughts and fences aside; empty without one."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?s)^.*</think>", "")
    t = F.regexp_replace(t, r"```(?:json)?", "")
    return F.regexp_extract(t, r"(?s)(\{.*\})", 1)


def front_matter(text: Column) -> Column:
    """The block between the leading dashes; empty without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---[ \t\r]*\n(.*?)\n---[ \t\r]*(?:\n|$)", 1)


def front_value(block: Column, key: str) -> Column:
    """A scalar of the block without quotes; the last one wins; null if the key is missing."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.regexp_extract(x, r"^\s*([^:]+?)\s*:", 1) == key)
    value = strip(F.regexp_replace(F.element_at(lines, -1), r"^[^:]*:", ""))
    return F.when(F.size(lines) > 0, F.regexp_replace(value, "^[\"']+|[\"']+$", ""))


def front_list(block: Column, key: str) -> Column:
    """An inline list of the block; a scalar becomes a list of one."""
    v = front_value(block, key)
    items = F.split(F.regexp_replace(v, r"^\[|\]$", ""), ",")
    clean = F.transform(items, lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", ""))
    return F.when(v.isNotNull(), F.filter(clean, lambda x: x != ""))
