"""Normalisers of raw payloads (one fetched document per row) into results, reviews and page metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.lexicon import any_of
from attesta.functions.text import host_of, normalize_html_text, normalized, strip
from attesta.operators.rank import containing, top

RESULT = ["query_key", "url", "title", "content", "snippet", "source", "source_type", "published_date"]


def _text(c: Column) -> Column:
    """Text of a piece of markup."""
    return strip(F.regexp_replace(normalized(F.regexp_replace(c, r"<[^>]+>", " ")), r"\s+", " "))


def _some(*cs: str) -> Column:
    """The first that is neither null nor blank; "" if none is."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs), F.lit(""))


def feed_items(feeds: DataFrame, per_query: int) -> DataFrame:
    """RSS documents (query_key, xml): the first items that have a title and a link."""
    item = "struct<title:string,link:string,description:string,source:string,pubDate:string>"
    parsed = F.from_xml("xml", f"channel struct<item:array<{item}>>")
    items = feeds.select("query_key", F.posexplode(parsed["channel"]["item"]).alias("pos", "i")).select("query_key", "pos", "i.*")
    items = top(items.where("trim(title) <> '' and trim(link) <> ''"), ["query_key"], [F.col("pos")], per_query)
    day = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), F.lit("")), F.lit("d MMM yyyy")))
    said = F.coalesce(F.nullif(_text(F.col("description")), F.lit("")), F.trim("title"))
    return items.select("query_key", F.trim("link").alias("url"), F.trim("title").alias("title"), said.alias("content"), said.alias("snippet"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Google News")).alias("source"), F.lit("news").alias("source_type"), day.cast("string").alias("published_date"))


#: JSON shapes of search providers: where the list is, and for each field the paths that may have it.
SERP_SHAPES = {
    "organic": ("organic_results array<struct<link:string,title:string,snippet:string,source:string,date:string,publication_info:struct<summary:string>>>", "organic_results", {"url": ("link",), "title": ("title",), "content": ("snippet",), "snippet": ("snippet",), "source": ("source", "publication_info.summary"), "published_date": ("date",)}),
    "crawl": ("data struct<web:array<struct<url:string,title:string,markdown:string,description:string,snippet:string,metadata:struct<title:string,sourceURL:string,siteName:string,publishedTime:string>>>>", "data.web", {"url": ("url",), "title": ("title", "metadata.title"), "content": ("markdown",), "snippet": ("description", "snippet"), "source": ("metadata.sourceURL", "metadata.siteName"), "published_date": ("metadata.publishedTime",)}),
    "neural": ("results array<struct<url:string,title:string,text:string,highlight:string,author:string,siteName:string,publishedDate:string>>", "results", {"url": ("url",), "title": ("title",), "content": ("text",), "snippet": ("text", "highlight"), "source": ("author", "siteName"), "published_date": ("publishedDate",)}),
}


def serp_json(payloads: DataFrame, shape: str) -> DataFrame:
    """Provider answers (query_key, json) of one of SERP_SHAPES to results; items without a url go, broken JSON gives none."""
    schema, path, fields = SERP_SHAPES[shape]
    items = payloads.select("query_key", F.from_json("json", schema).alias("j")).select("query_key", F.posexplode(F.col(f"j.{path}")).alias("pos", "i"))
    made = {f: _some(*(f"i.{p}" for p in paths)) for f, paths in fields.items()}
    made |= {"snippet": F.substring(made["snippet"], 1, 700), "published_date": F.nullif(made["published_date"], F.lit("")), "source_type": F.lit("")}
    return items.select("query_key", *(made[c].alias(c) for c in RESULT[1:])).where("url <> ''")


def redirect_target(href: Column) -> Column:
    """The target of a search engine's redirect link; other links as they are."""
    full = F.when(F.startswith(F.trim(href), F.lit("//")), F.concat(F.lit("https:"), F.trim(href))).otherwise(F.trim(href))
    target = F.try_url_decode(F.regexp_extract(full, r"[?&]uddg=([^&#]*)", 1))
    return F.when(F.contains(host_of(full), F.lit("duckduckgo.com")), F.coalesce(target, F.lit(""))).otherwise(full)


def serp_html(pages: DataFrame, per_query: int = 50) -> DataFrame:
    """Result pages (query_key, html): each block with a link to a result."""
    block = r'(?is)<div[^>]*class="[^"]*\bresult\b[^"]*".*?(?=<div[^>]*class="[^"]*\bresult\b[^"]*"|\z)'
    blocks = pages.select("query_key", F.posexplode(F.regexp_extract_all("html", F.lit(block), 0)).alias("pos", "b"))
    link = F.regexp_extract("b", r'(?is)<a[^>]*class="[^"]*result__a[^"]*"[^>]*>', 0)
    part = lambda name: _text(F.regexp_extract("b", rf'(?is)<\w+[^>]*class="[^"]*{name}[^"]*"[^>]*>(.*?)</(?:a|span|div)>', 1))
    url = redirect_target(F.regexp_extract(link, r'(?i)\bhref="([^"]*)"', 1))
    out = blocks.where(link != "").select("query_key", "pos", url.alias("url"), part("result__a").alias("title"), part("result__snippet").alias("content"), part("result__url").alias("_source"))
    out = top(out.where("url <> ''"), ["query_key"], [F.col("pos")], per_query)
    return out.select("query_key", "url", "title", "content", F.col("content").alias("snippet"), F.coalesce(F.nullif(F.col("_source"), F.lit("")), host_of(F.col("url"))).alias("source"), F.lit("").alias("source_type"), F.lit(None).cast("string").alias("published_date"))


def unwrap_link(url: Column) -> Column:
    """The url inside an aggregator link whose path ends articles/<base64>; other links as they are."""
    code = F.regexp_extract(url, r"^https?://news\.google\.com/(?:.*/)?articles/([A-Za-z0-9_-]+)", 1)
    padded = F.concat(F.translate(code, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(code), F.lit(4))))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    # three bytes stand before and after, one or two before the url say its length
    body = F.regexp_replace(F.regexp_replace(raw, "^\x08\x13\"", ""), "\xd2\x01\x00$", "")
    body = F.when(F.rlike(body, F.lit("(?s)^[\x80-\xff].")), F.substring(body, 3, 1 << 30)).otherwise(F.substring(body, 2, 1 << 30))
    inside = F.regexp_extract(body, r"https?://[^\s\x00\xd2]+", 0)
    plain = F.encode(inside, "ISO-8859-1")
    sound = F.coalesce(inside != "", F.lit(False)) & F.is_valid_utf8(plain.cast("string"))
    return F.when((code != "") & sound, F.decode(plain, "UTF-8")).otherwise(url)


def forum_pushes(pages: DataFrame, default_year: int) -> DataFrame:
    """Forum articles (article_id, url, board, title, html): a review for each push that says something."""
    stamp = F.regexp_replace(F.regexp_extract("html", r"\w{3} (\w{3}\s+\d{1,2} \d\d:\d\d:\d\d \d{4})", 1), r"\s+", " ")
    article = F.to_date(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("MMM d HH:mm:ss yyyy")))
    pushes = F.regexp_extract_all("html", F.lit(r'(?s)<div class="push">(.*?)</div>'), 1)
    rows = pages.withColumn("_day", article).select("article_id", "url", "board", "title", "_day", F.posexplode(pushes).alias("pos", "p"))
    part = lambda name: _text(F.regexp_extract("p", rf'(?s)<span class="[^"]*{name}[^"]*">(.*?)</span>', 1))
    at = part("push-ipdatetime")
    month, day = (F.nullif(F.regexp_extract(at, r"(\d{1,2})/(\d{1,2})\s+\d{1,2}:\d{2}", i), F.lit("")) for i in (1, 2))
    date = F.concat_ws("-", F.coalesce(F.year("_day"), F.lit(default_year)).cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    content = strip(F.regexp_replace(part("push-content"), r"^: ?", ""))
    tag = F.regexp_extract(part("push-tag"), "[推噓→]", 0)
    out = rows.select("article_id", "pos", content.alias("content"), F.nullif(part("push-userid"), F.lit("")).alias("author"), F.nullif(tag, F.lit("")).alias("sentiment"), F.col("url").alias("source_url"), F.concat(F.lit("[PTT/"), "board", F.lit("] "), "title").alias("parent_title"), F.when(month.isNotNull(), date).otherwise(F.col("_day").cast("string")).alias("published_at"))
    return out.where("content <> ''")


def forum_article_text(html: Column, chars: int = 700) -> Column:
    main = F.regexp_extract(html, r'(?s)<div id="main-content"[^>]*>(.*)', 1)
    for name in ("article-metaline(?:-right)?", "push"):
        main = F.regexp_replace(main, rf'(?s)<div class="{name}">.*?</div>', " ")
    return F.substring(_text(main), 1, chars)


def forum_listing(pages: DataFrame, keywords: DataFrame, year: int, per_keyword: int = 5, contents: DataFrame | None = None) -> DataFrame:
    """Listing pages (board, html) to articles whose title has a keyword (keyword, entity), the first per board and keyword.

    contents: texts of articles (path, content) where they are known, added to the rows; an article whose text has none of its entity's
    keywords goes, one without a text stays.
    """
    block = r'(?s)<div class="r-ent">(.*?)(?=<div class="r-ent">|\z)'
    rows = pages.select("board", F.posexplode(F.regexp_extract_all("html", F.lit(block), 1)).alias("pos", "b"))
    link = F.regexp_extract("b", r'<a href="([^"]+)"', 1)
    day = F.regexp_extract("b", r'<div class="date">\s*(\d{1,2}/\d{1,2})', 1)
    rows = rows.select("board", "pos", link.alias("path"), _text(F.regexp_extract("b", r'(?s)<div class="title">(.*?)</div>', 1)).alias("title"), F.to_date(F.try_to_timestamp(F.concat(F.lit(f"{year}/"), day), F.lit("yyyy/M/d"))).alias("day"), F.expr("try_cast(regexp_extract(b, '<span class=\"hl[^\"]*\">(\\\\d+)', 1) as int)").alias("pushes"))
    met = containing(rows.where("path <> ''"), F.lower("title"), keywords, F.lower("keyword"))
    if contents is not None:
        words = keywords.where("keyword <> ''").groupBy("entity").agg(F.collect_set(F.lower("keyword")).alias("_words"))
        known = contents.groupBy("path").agg(F.max("content").alias("content"))
        met = met.join(known.hint("merge"), "path", "left").join(words.hint("merge"), "entity", "left")
        empty = F.coalesce("content", F.lit("")) == ""
        met = met.where(empty | F.exists("_words", lambda w: F.contains(F.lower("content"), w))).drop("_words")
    return top(met, ["board", "keyword"], [F.col("pos")], per_keyword)


#: Lines of a thread page that are no posts.
THREAD_NOISE = ("登入", "註冊", "Threads", "使用條款", "隱私政策", "Cookie", "暢所欲言", "加入", "© 2", "翻譯", "• Instagram ", "Instagram 相片與影片", "• Facebook", "Facebook 貼文")


def thread_posts(pages: DataFrame) -> DataFrame:
    """Thread pages (page_id, url, text): each line of ten characters or more is a post of the last name above it."""
    rows = pages.select("page_id", "url", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    noise = F.exists(F.array(*map(F.lit, THREAD_NOISE)), lambda x: F.contains("line", x)) | (F.length("line") < 3)
    preview = F.rlike("line", F.lit(r"^(https?://|www\.)?(instagram\.com|facebook\.com|youtube\.com|youtu\.be|fb\.com|threads\.net|t\.co)[/\w@.]*[….]+$"))
    is_name = F.rlike("line", F.lit(r"^[A-Za-z0-9._]+$")) & (F.length("line") < 40)
    rows = rows.where(~noise & ~preview).withColumn("_name", is_name)
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("author", F.last(F.when(F.col("_name"), F.col("line")), ignorenulls=True).over(above))
    said = ~F.col("_name") & ~F.rlike("line", F.lit(r"^([\d,]+$|\d+[天時分秒]|\d{4}-\d{1,2}-\d{1,2})")) & (F.length("line") >= 10) & F.col("author").isNotNull()
    return rows.where(said).select("page_id", "pos", F.substring("line", 1, 500).alias("content"), "author", F.col("url").alias("source_url"), F.lit("[Threads]").alias("parent_title"))


def forum_post_clean(text: Column, noise: tuple[str, ...] = ()) -> Column:
    """Posts without footer lines and quotation counts; null if under 15 characters are left."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^\d+ 引言$")))
    lines = F.filter(lines, lambda x: ~any_of(x, noise))
    out = F.array_join(lines, "\n")
    return F.when(F.length(out) >= 15, out)


def forum_snippet(title: Column, snippet: Column) -> Column:
    """What stands for a thread that could not be read: its title and snippet; null if both are short."""
    title, snippet = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    text = F.when(snippet != "", strip(F.concat(title, F.lit("\n"), snippet))).otherwise(title)
    return F.when((F.length(snippet) >= 20) | (F.length(title) >= 10), text)


def review_author(title: Column) -> Column:
    """The writer in the title of a place review; null if there is none."""
    return F.nullif(strip(F.regexp_extract(title, r"評論\]([^—]*)", 1)), F.lit(""))


def place_summaries(places: DataFrame) -> DataFrame:
    """A row for each place answer (place_id, name, json) that has a rating: title, content, rating and reviews_count."""
    info = F.from_json("json", "place_info struct<title:string,address:string,rating:string,reviews:string>")["place_info"]
    rows = places.select("place_id", "name", info.alias("p")).where("p.rating is not null")
    name, count = F.coalesce("p.title", "name"), F.coalesce("p.reviews", F.lit("None"))
    title = F.concat(F.lit("[Google Maps] "), name, F.lit(" — 評分 "), F.col("p.rating"), F.lit("/5 ("), count, F.lit(" 則評論)"))
    content = F.concat(name, F.lit("，地址："), F.coalesce("p.address", F.lit("")), F.lit("。Google Maps 平均評分 "), F.col("p.rating"), F.lit("/5，共 "), count, F.lit(" 則評論。"))
    return rows.select("place_id", title.alias("title"), content.alias("content"), F.col("p.rating").alias("rating"), F.col("p.reviews").alias("reviews_count"))


def star_rating(raw: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.bround(raw.try_cast("double")).cast("int")), F.lit(0))


def place_reviews(places: DataFrame) -> DataFrame:
    """Place answers (place_id, json) to reviews; an empty one says its rating."""
    schema = "reviews array<struct<user:struct<name:string>,rating:string,snippet:string,extracted_snippet:struct<original:string>,date:string,link:string>>"
    rows = places.select("place_id", F.posexplode(F.from_json("json", schema)["reviews"]).alias("pos", "r"))
    name, stars = F.coalesce(F.col("r.user.name"), F.lit("匿名用戶")), star_rating(F.col("r.rating"))
    said = F.substring(_some("r.snippet", "r.extracted_snippet.original"), 1, 700)
    empty = F.concat(name, F.lit(" 給予 "), stars.cast("string"), F.lit(" 星評價。"))
    return rows.select("place_id", "pos", name.alias("author"), stars.alias("rating"), F.when(said == "", empty).otherwise(said).alias("content"), F.concat(F.lit("[Google Maps 評論] "), name, F.lit(" — "), F.repeat(F.lit("⭐"), stars)).alias("parent_title"), F.col("r.link").alias("source_url"))


#: Shapes of crawled social items: text keys, most characters, author keys, url keys, like keys, time keys, title.
ACTOR_SHAPES = {
    "instagram_posts": (("caption",), 1000, ("ownerUsername",), ("url",), ("likesCount",), ("timestamp",), "[Instagram 貼文]"),
    "instagram_comments": (("text",), 500, ("ownerUsername",), ("postUrl",), ("likesCount",), ("timestamp",), "[Instagram 留言]"),
    "facebook_posts": (("text", "message"), 1000, ("user.name", "pageName"), ("url", "postUrl"), ("likes",), ("time", "timestamp"), "[Facebook 貼文]"),
    "group_posts": (("text", "message"), 1500, ("user.name", "authorName"), ("url", "postUrl"), ("likesCount",), ("time", "timestamp"), "[Facebook 社團]"),
    "facebook_comments": (("text",), 500, ("profileName", "user"), ("commentUrl", "postUrl"), ("likesCount", "reactionsCount"), ("date", "timestamp"), "[Facebook 留言]"),
}


def actor_items(items: DataFrame, kind: str) -> DataFrame:
    """Crawled social items (item_id, json) of one of ACTOR_SHAPES to reviews; blank ones go."""
    text, chars, author, url, likes, at, title = ACTOR_SHAPES[kind]
    get = lambda keys: F.coalesce(*(F.nullif(F.trim(F.get_json_object("json", f"$.{k}")), F.lit("")) for k in keys))
    rows = items.select("item_id", F.substring(get(text), 1, chars).alias("content"), get(author).alias("author"), F.coalesce(get(url), F.lit("")).alias("source_url"), F.lit(title).alias("parent_title"), F.coalesce(get(likes).try_cast("int"), F.lit(0)).alias("likes"), get(at).alias("published_at"))
    return rows.where(F.col("content").isNotNull())


def board_posts_json(payloads: DataFrame, chars: int = 700) -> DataFrame:
    """Board answers (query_key, json: an array of posts) to results."""
    schema = "array<struct<id:string,title:string,excerpt:string,content:string,forumName:string,createdAt:string,likeCount:int,commentCount:int>>"
    rows = payloads.select("query_key", F.posexplode(F.from_json("json", schema)).alias("pos", "p"))
    forum = F.coalesce(F.col("p.forumName"), F.lit(""))
    url = F.when(F.col("p.id").isNotNull(), F.concat(F.lit("https://www.dcard.tw/f/"), forum, F.lit("/p/"), F.col("p.id"))).otherwise("")
    content = F.substring(_some("p.content", "p.excerpt"), 1, chars)
    day = F.to_date(F.try_to_timestamp(F.col("p.createdAt")))
    return rows.select("query_key", url.alias("url"), F.concat(F.lit("[Dcard/"), forum, F.lit("] "), F.coalesce(F.col("p.title"), F.lit(""))).alias("title"), content.alias("content"), content.alias("snippet"), F.concat(F.lit("Dcard "), forum).alias("source"), F.lit("forum").alias("source_type"), day.cast("string").alias("published_date"))


def page_posts(posts: DataFrame) -> DataFrame:
    """Page posts (entity, user, text) that name the entity."""
    head = F.concat(F.lit("[Facebook/"), "user", F.lit("] "), F.substring("text", 1, 60), F.lit("..."))
    return posts.where(F.contains(F.lower("text"), F.lower("entity"))).withColumn("title", head)


def results_to_reviews(results: DataFrame, limit: int) -> DataFrame:
    """Results (query_key, ord, ...) to reviews: the first of each url that has a title or content, at most `limit` a query."""
    title, content = F.trim(F.coalesce("title", F.lit(""))), F.trim(_some("content", "snippet"))
    rows = results.where(F.trim("url") != "").withColumn("_c", F.row_number().over(Window.partitionBy("query_key", F.trim("url")).orderBy("ord")))
    rows = rows.where("_c = 1").where((title != "") | (content != ""))
    rows = top(rows, ["query_key"], [F.col("ord")], limit)
    source = F.coalesce("source", F.lit(""))
    body = F.when(content != "", F.trim(F.concat(title, F.lit("\n"), content))).otherwise(title)
    return rows.select("query_key", "ord", body.alias("content"), source.alias("author"), F.col("url").alias("source_url"), F.when(source != "", F.concat(F.lit("[新聞/"), source, F.lit("]"))).otherwise("[新聞]").alias("parent_title"), F.col("published_date").alias("published_at"))


def read_alias_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))
    pair = rows.select(F.trim("canonical_name").alias("canonical_name"), F.trim("alias").alias("alias"))
    return pair.where("canonical_name <> '' and alias <> ''")


def read_registry(spark: SparkSession, path: str, labels: dict[str, str]) -> dict[str, DataFrame]:
    """A registry CSV (name, aliases, page_url and labelled fields) to entities, keywords, intros, watchlist and pages."""
    rows = spark.read.csv(path, header=True).where("trim(name) <> ''").withColumn("name", F.trim("name"))
    alias = rows.select("name", F.explode(F.split(F.coalesce("aliases", F.lit("")), "[/,、，]")).alias("keyword")).withColumn("keyword", strip(F.col("keyword")))
    lines = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{label}："), F.trim(c))) for c, label in labels.items()]
    page = F.regexp_replace(F.regexp_replace(F.trim("page_url"), r"\?.*$", ""), "/+$", "")
    return {
        "entities": rows.select("name"),
        "keywords": alias.where("keyword <> '' and keyword <> name").withColumn("weight", F.lit(70)),
        "intros": rows.select("name", F.concat_ws("\n", *lines).alias("intro")),
        "watchlist": rows.select("name", F.lit(3).alias("priority"), F.lit(720).alias("refresh_interval_hours")),
        "pages": rows.select("name", page.alias("page_url")).where(F.rlike("page_url", F.lit(r"^https?://[^/]*(facebook|fb)\."))),
    }


def page_map(config: DataFrame) -> DataFrame:
    """Page lists (text: "e1|u1,u2;e2|u3", or plain urls for all) to (key, url); a later list of a key replaces an earlier one."""
    parts = config.select(F.posexplode(F.split("text", ";")).alias("pos", "part")).where("trim(part) <> ''")
    named = F.contains("part", F.lit("|"))
    key = F.when(named, F.lower(F.trim(F.element_at(F.split("part", r"\|", 2), 1)))).otherwise("_default")
    urls = F.when(named, F.element_at(F.split("part", r"\|", 2), -1)).otherwise(F.col("part"))
    last = parts.select(key.alias("key"), "pos", urls.alias("urls")).groupBy("key").agg(F.when(F.first("key") == "_default", F.array_join(F.array_agg("urls"), ",")).otherwise(F.max_by("urls", "pos")).alias("urls"))
    return last.select("key", F.explode(F.split("urls", ",")).alias("url")).withColumn("url", F.trim("url")).where("url <> ''")


def pages_of(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages (key, url, of page_map) of each entity (entity_id, name, aliases): those of its name, else of its first alias that has
    any, else the default ones."""
    keys = F.concat(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower), F.array(F.lit("_default")))
    asked = entities.select("entity_id", F.posexplode(keys).alias("pos", "key"))
    found = asked.join(pages.hint("merge"), "key")
    best = found.groupBy(F.col("entity_id").alias("_id")).agg(F.min("pos").alias("_pos"))
    return found.join(best.hint("merge"), (F.col("entity_id") == F.col("_id")) & (F.col("pos") == F.col("_pos"))).select("entity_id", "url").distinct()


def read_groups_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, multiLine=True, schema="note string, groups array<struct<url:string,name:string,topic:string>>")
    return rows.select(F.explode("groups").alias("g")).select("g.*").where("trim(url) <> ''")


def absolute_url(base: Column, url: Column) -> Column:
    """A link of a page as an absolute url."""
    root, folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    made = F.when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(root, F.lit("/"))), url))
    return F.when(url == "", "").when(F.rlike(url, F.lit(r"^[a-zA-Z][\w+.-]*:")), url).when(F.startswith(url, F.lit("//")), F.concat(scheme, url)).otherwise(made)


def usable_image(url: Column) -> Column:
    low = F.lower(F.trim(url))
    return F.rlike(low, F.lit("^https?://")) & ~F.rlike(F.regexp_extract(low, r"^https?://[^/?#]*([^?#]*)", 1), F.lit("favicon|sprite|avatar|icon|logo")) & ~F.endswith(low, F.lit(".svg"))


_META = r"""(?i)<meta[^>]+(?:property|name)=['"](?:{names})['"][^>]+content=['"]([^'"]+)['"]"""


def page_metadata(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """(page_id, url, title, description, images, links) of pages (page_id, url, html).

    The description is the first of 20 characters or more among the meta tags, else the start of the text. Images are those of meta
    tags, then of img tags, as absolute urls that may be shown, in order, once each.
    """
    tidy = normalize_html_text if normalize else (lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    title = tidy(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    metas = F.filter(F.regexp_extract_all("html", F.lit(_META.format(names="description|og:description|twitter:description")), 1), lambda d: F.length(d) >= 20)
    body = F.substring(tidy(F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<[^>]+>", " ")), 1, 320)
    found = F.concat(F.regexp_extract_all("html", F.lit(_META.format(names="og:image|og:image:url|twitter:image|image")), 1), F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*?\bsrc=['"]([^'"]+)['"]"""), 1))
    images = F.array_distinct(F.filter(F.transform(found, lambda u: absolute_url(F.col("url"), F.trim(u))), usable_image))
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="([^"]*)"'), 1)
    return pages.select("page_id", "url", title.alias("title"), F.coalesce(F.get(metas, 0), F.when(F.length(body) >= 20, body), F.lit("")).alias("description"), images.alias("images"), links.alias("links"))


def og_image(url: Column, html: Column) -> Column:
    """The first share image, whichever way round its tag is written, as an absolute url."""
    patterns = []
    for name in ("og:image", "twitter:image"):
        patterns += [rf"""(?i)<meta[^>]+(?:property|name)=['"]{name}['"][^>]+content=['"]([^'"]+)['"]""", rf"""(?i)<meta[^>]+content=['"]([^'"]+)['"][^>]+(?:property|name)=['"]{name}['"]"""]
    first = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns))
    return absolute_url(url, F.replace(first, F.lit("&amp;"), F.lit("&")))


def intro_urls(intro: Column) -> Column:
    """Struct of the first page of a social site and the first other url of an introduction."""
    urls = F.transform(F.regexp_extract_all(intro, F.lit(r"https?://[^\s）)、，]+"), 0), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))
    social = lambda u: F.rlike(u, F.lit(r"(?i)^https?://[^/]*(facebook|fb)\."))
    return F.struct(F.get(F.filter(urls, social), 0).alias("page_url"), F.get(F.filter(urls, lambda u: ~social(u)), 0).alias("site_url"))


def official_gallery(pages: DataFrame, most_pages: int = 3, most_images: int = 6) -> DataFrame:
    """From page metadata with entity and ord: each entity's first pages, the images of these, and the copy of the first one that has any."""
    few = top(pages.withColumn("_c", F.row_number().over(Window.partitionBy("entity", "url").orderBy("ord"))).where("_c = 1"), ["entity"], [F.col("ord")], most_pages)
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "title", "description", "images")))
    rows = few.groupBy("entity").agg(by_rank.alias("p"))
    has = F.get(F.filter("p", lambda x: (x["title"] != "") | (x["description"] != "")), 0)
    images = F.slice(F.array_distinct(F.flatten(F.transform("p", lambda x: x["images"]))), 1, most_images)
    return rows.select("entity", F.size("p").alias("pages"), images.alias("images"), F.substring(has["title"], 1, 120).alias("headline"), F.substring(has["description"], 1, 320).alias("intro"))
