"""Pages of a documentation site: texts, positions, sidebar, links.

Nulls: a page without path has none of these; a missing position counts as the
last. Of pages with one path the last by ``ord`` holds, at the place of the
first. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Sections by the start of a page's path, in order, with their positions. Fixed values.
SECTIONS = (("endpoints", "api/", 10), ("entities", "entities/", 100), ("architecture", "architecture", 1000), ("changelog", "changelog", 9999), ("components", "components/", 999), ("services", "hooks/", 999))
#: Where a page without a position stands.
LAST = 999


def endpoint_pages(endpoints: DataFrame) -> DataFrame:
    """(project, path, title, position, content): a page per handling class with its endpoints by protocol and path; positions from 10 on by class.

    A page's text is as large as the list of its endpoints.
    """
    e = lambda c: T.escape_markdown(F.coalesce(c, F.lit("")))
    row = lambda p: F.concat(F.lit("| "), e(p["name"]), F.lit(" | `"), e(p["type"]), F.lit("` | "), F.when(p["required"], "✓").otherwise(""), F.lit(" | "), F.coalesce(p["location"], F.lit("-")), F.lit(" |\n"))
    params = F.when(F.size("parameters") > 0, F.concat(F.lit("| Name | Type | Required | Location |\n|---|---|---|---|\n"), F.array_join(F.transform("parameters", row), ""), F.lit("\n"))).otherwise("")
    head = (
        F.when((F.col("protocol") == "rest") & F.col("httpMethod").isNotNull() & F.col("path").isNotNull(), F.concat(F.lit("`"), "httpMethod", F.lit("` `"), "path", F.lit("`\n\n")))
        .when((F.col("protocol") == "graphql") & F.col("operationType").isNotNull() & F.col("fieldName").isNotNull(), F.concat(F.lit("**GraphQL "), "operationType", F.lit("**: `"), "fieldName", F.lit("`\n\n")))
        .otherwise(F.concat(F.lit("**Protocol**: "), F.coalesce("protocol", F.lit("")), F.lit("\n\n")))
    )
    badges = F.concat_ws(" · ", F.when(F.col("auth"), "auth required"), F.when(F.col("deprecated"), "deprecated"))
    text = F.concat(F.lit("## "), F.coalesce("name", F.lit("")), F.lit("\n\n"), head, F.when(badges != "", F.concat(badges, F.lit("\n\n"))).otherwise(""), params, F.lit("**Returns**: `"), e(F.col("returnType")), F.lit("`\n"))
    rows = endpoints.select("project", F.coalesce("handlerClass", F.lit("misc")).alias("title"), F.struct(F.coalesce("protocol", F.lit("")).alias("a"), F.coalesce("path", "fieldName", F.lit("")).alias("b"), F.col("id"), text.alias("text")).alias("e"))
    lists = rows.groupBy("project", "title").agg(F.array_sort(F.collect_list("e")).alias("l"))
    place = F.row_number().over(Window.partitionBy("project").orderBy("title")) + 9
    return lists.select("project", F.concat(F.lit("api/"), T.to_kebab(F.col("title")), F.lit(".md")).alias("path"), "title", place.alias("position"), F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("content"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def last_of(pages: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Per key the values of the last row, at the place of the first (``place``)."""
    return pages.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("place")).select(*keys, "v.*", "place")


def section(path: Column) -> Column:
    """The section that a page's path begins with; ``auto`` for the overview and the index; null without one."""
    c = F.when(F.lit(False), F.lit(""))
    for name, prefix, _ in SECTIONS:
        c = c.when(F.startswith(path, F.lit(prefix)), name)
    return c.when(path.isin("overview.md", "index.md"), "auto")


def sidebar(pages: DataFrame, group: str = "project") -> DataFrame:
    """(group, section, kind, rank, path, title, section_position): pages (path, title, position) by section; a section of one page is that page itself."""
    known = pages.withColumn("section", section(F.col("path"))).where("section is not null")
    place = F.coalesce(F.nullif("position", F.lit(0)), F.lit(LAST))
    by = Window.partitionBy(group, "section")
    rank = F.row_number().over(by.orderBy(place, "path"))
    table = F.create_map(*[F.lit(x) for n, _, p in SECTIONS for x in (n, p)])
    at = F.when(F.count("*").over(by) == 1, place).otherwise(F.coalesce(F.try_element_at(table, "section"), F.lit(0)))
    return known.select(group, "section", F.when(F.count("*").over(by) == 1, "doc").otherwise("category").alias("kind"), rank.alias("rank"), "path", "title", at.alias("section_position"))


def front_matter(title: Column, description: Column, tags: Column, position: Column, path: Column) -> Column:
    """The block of a page's settings, in their fixed order; what is null is left out."""
    quoted = lambda key, c: F.concat(F.lit(f'{key}: "'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws(
        "\n", F.lit("---"), quoted("title", F.coalesce(title, F.lit(""))), quoted("description", description),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform(tags, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))),
        F.concat(F.lit("sidebar_position: "), position.cast("string")), quoted("page_id", F.regexp_replace(path, r"\.md$", "")), F.lit("---"), F.lit(""),
    )


def links(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, link): the relative Markdown links of pages, without anchors and queries."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1)
    rows = pages.select(key, F.explode(found).alias("link")).where(~F.col("link").rlike("^(?:[a-z][a-z0-9+.-]*:|#|//)"))
    return rows.select(key, F.regexp_replace("link", "[?#].*$", "").alias("link")).where("link <> ''")


def resolved(links: DataFrame, slugs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, link, target): a link to a known slug (slug), to the index of a folder, to the first slug in it, else ``index``."""
    plain = F.regexp_replace(F.regexp_replace("link", r"^(?:\./|\.\./|/)+", ""), r"(?:\.md|\.html|/)$", "")
    asked = links.withColumn("want", plain)
    known = slugs.select("slug").distinct()
    starts = known.select("slug", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("slug", "/"))), lambda i: F.array_join(F.slice(F.split("slug", "/"), 1, i), "/"))).alias("folder")).where("slug <> folder")
    inside = starts.groupBy("folder").agg(F.min("slug").alias("first"))
    out = asked.join(known.withColumn("want", F.col("slug")), "want", "left").join(known.select(F.col("slug").alias("of_index"), F.regexp_replace("slug", "/index$", "").alias("want")).where("of_index <> want"), "want", "left").join(inside.withColumnRenamed("folder", "want"), "want", "left")
    return out.select(key, "link", F.coalesce("slug", "of_index", "first", F.lit("index")).alias("target"))


def service_pages(services: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, path, title, position, content): a page per service with its methods, what it depends on and what uses it; positions from 300 on."""
    users = edges.groupBy("project", F.col("target").alias("name")).agg(F.array_sort(F.collect_set("source")).alias("users"))
    row = services.join(users, ["project", "name"], "left")
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"), F.lit("\n\n"))).otherwise("")
    place = F.row_number().over(Window.partitionBy("project").orderBy("name")) + 299
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), listed("Methods", F.col("methods")), listed("Dependencies", F.col("dependencies")), listed("Used by", F.coalesce("users", F.array().cast("array<string>"))))
    return row.select("project", F.concat(F.lit("hooks/"), T.to_kebab(F.col("name")), F.lit(".md")).alias("path"), F.col("name").alias("title"), place.alias("position"), text.alias("content"))


def entity_pages(entities: DataFrame) -> DataFrame:
    """(project, path, title, position, content): a page per entity with tables of its columns and relations; positions from 100 on."""
    cell = lambda c: T.escape_markdown(F.coalesce(c, F.lit("")))
    columns = F.when(F.size("columns") > 0, F.concat(F.lit("| Column | Type | Nullable |\n|---|---|---|\n"), F.array_join(F.transform("columns", lambda c: F.concat(F.lit("| "), cell(c["name"]), F.lit(" | `"), cell(c["type"]), F.lit("` | "), F.when(c["nullable"], "✓").otherwise(""), F.lit(" |\n"))), ""))).otherwise("")
    relations = F.when(F.size("relations") > 0, F.concat(F.lit("\n| Relation | Target |\n|---|---|\n"), F.array_join(F.transform("relations", lambda r: F.concat(F.lit("| "), cell(r["type"]), F.lit(" | `"), cell(r["target"]), F.lit("` |\n"))), ""))).otherwise("")
    place = F.row_number().over(Window.partitionBy("project").orderBy("name")) + 99
    text = F.concat(F.lit("# "), "name", F.lit("\n\nTable: `"), "tableName", F.lit("`\n\n"), columns, relations)
    return entities.select("project", F.concat(F.lit("entities/"), T.to_kebab(F.col("name")), F.lit(".md")).alias("path"), F.col("name").alias("title"), place.alias("position"), text.alias("content"))


def head_tags(title: Column, meta: Column) -> Column:
    """The tags of a page's head out of its settings, with the fallbacks of the social ones."""
    of = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in keys])
    tag = lambda kind, key, value: F.concat(F.lit(f'<meta {kind}="{key}" content="'), T.escape_html(value), F.lit('" />'))
    og_title = F.coalesce(of("og_title"), title)
    card = of("twitter_card", "og_image").isNotNull()
    return F.concat_ws(
        "\n    ", F.concat(F.lit("<title>"), T.escape_html(title), F.lit("</title>")), tag("name", "description", of("description")), tag("name", "keywords", of("tags")), F.concat(F.lit('<link rel="canonical" href="'), T.escape_html(of("canonical")), F.lit('" />')), tag("name", "robots", of("robots")),
        tag("property", "og:title", og_title), tag("property", "og:description", of("og_description", "description")), tag("property", "og:image", of("og_image")), tag("property", "og:type", F.coalesce(of("og_type"), F.lit("article"))),
        F.when(card, tag("name", "twitter:card", F.coalesce(of("twitter_card"), F.lit("summary")))), F.when(card, tag("name", "twitter:title", F.coalesce(of("twitter_title"), og_title))), F.when(card, tag("name", "twitter:description", of("twitter_description", "og_description", "description"))), F.when(card, tag("name", "twitter:image", of("twitter_image", "og_image"))),
    )
