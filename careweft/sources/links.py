"""Links found in HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.functions.predicates import as_column

# Parts of a page whose text is not markup.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
# An anchor tag; quoted values may hold any character.
ANCHOR = r"""(?is)<a\s((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
# Other attributes with their values, then the one asked for: names inside a value do not count.
ATTRIBUTE = (
    r"""(?is)^\s*(?:(?!{name}[\s=])[^\s=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"']+))?\s*)*+"""
    r"""{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']*))"""
)
# Character references in links; that of the ampersand comes last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside the text of a tag, null when absent."""
    pattern = ATTRIBUTE.format(name=name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for reference, character in REFERENCES.items():
        value = F.replace(value, F.lit(reference), F.lit(character))
    return F.when(tag.rlike(pattern), value)


def resolve_link(page: Column | str, link: Column | str) -> Column:
    """A link made absolute against the address of its page.

    Handles absolute, `//host`, `/root`, `?query`, `#part` and relative links;
    `.` and `..` steps are resolved.
    """
    page, link = as_column(page), as_column(link)
    bare = F.regexp_replace(page, "[?#].*$", "")
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    host = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def tidy(value: Column) -> Column:
        tail = F.regexp_extract(value, "([?#].*)$", 1)
        parts = F.split(F.regexp_replace(value, "[?#].*$", ""), "/", -1)
        last = F.element_at(parts, -1)
        kept = F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts) - 1),
            F.array().cast("array<string>"),
            lambda acc, p: F.when(p == ".", acc)
            .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(p))),
        )
        closing = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise("")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), closing, tail)

    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link == "", F.regexp_replace(page, "#.*$", ""))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(host, tidy(link)))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
        .otherwise(F.concat(host, tidy(F.concat(folder, link))))
    )


def link_file_name(link: Column | str) -> Column:
    """Last path part of an address, without query and fragment."""
    return F.substring_index(F.regexp_replace(as_column(link), "[?#].*$", ""), "/", -1)


def extract_links(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    match: str = "id",
    pattern: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Links of anchors whose attribute `match` fits a pattern.

    One row per anchor with a target: its place on the page, the link as
    written, the absolute link and the file name in it. Work stays in the row.
    """
    keep = keep if keep is not None else [c for c in pages.columns if c != html]
    tags = pages.select(
        *keep,
        F.col(url).alias("_page"),
        F.posexplode(F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(ANCHOR), F.lit(1))).alias(
            "_pos", "_tag"
        ),
    )
    tag = F.col("_tag")
    found = tags.withColumn("href", attribute(tag, "href")).filter(F.col("href").isNotNull())
    if pattern is not None:
        found = found.filter(attribute(tag, match).rlike(pattern))
    link = resolve_link("_page", "href")
    return found.select(
        *keep,
        (F.col("_pos") + 1).alias("anchor_no"),
        "href",
        link.alias("link"),
        link_file_name(link).alias("file_name"),
    )
