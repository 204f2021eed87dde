"""Corpus preparation: cleaning, chunking, tagging and keying of documents.

All generators work inside one row (no shuffle); only ``row_windows`` and the
content-key de-duplication exchange rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.operators.ordered import with_position


# ---------------------------------------------------------------- text cleaning
def clean_text(c: Column | str) -> Column:
    """Without HTML comments, with blank-line runs collapsed, stripped."""
    bare = F.regexp_replace(tx.text_or_empty(c), r"(?s)<!--.*?-->", "")
    return tx.strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def file_stem(path: Column | str) -> Column:
    name = F.element_at(F.split(tx.col(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*[^.]$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def markdown_title(content: Column | str, path: Column | str) -> Column:
    """First H1, else the file stem in title case."""
    h1 = F.nullif(tx.strip(F.regexp_extract(tx.col(content), r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    stem = F.translate(file_stem(path), "-_", "  ")
    return F.coalesce(h1, tx.title_case(stem))


def markdown_headers(content: Column | str) -> Column:
    """All H2 and H3 texts in order."""
    return F.transform(F.regexp_extract_all(tx.col(content), F.lit(r"(?m)^#{2,3}\s+(.+)$"), F.lit(1)), tx.strip)


def markdown_url(path: Column | str, prefix: str = "https://book.hacktricks.xyz/") -> Column:
    """Site address from the path below ``src`` (or the file name), without suffix, lower case."""
    path = tx.col(path)
    below = F.regexp_extract(path, r"(?:^|/)src/(.+)$", 1)
    rel = F.when(below != "", below).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(rel, r"(?<=[^/])\.[^./]+$", "")))


def tag_map(breadcrumb: Column | str) -> Column:
    """Service (first in list order) and category tags of a breadcrumb."""

    def tags(low: Column) -> Column:
        service = tx.first_group(low, [(s, (s,)) for s in rules.SERVICE_TAGS], "")
        category = tx.first_group(low, rules.CATEGORY_TAGS, rules.CATEGORY_DEFAULT)
        pairs = F.array(
            F.struct(F.lit("service").alias("k"), service.alias("v")), F.struct(F.lit("category").alias("k"), category.alias("v"))
        )
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"] != ""))

    return tx.let(F.lower(tx.text_or_empty(breadcrumb)), tags)


def source_tags(source: Column, source_type: Column, privesc: Sequence[str] = rules.PRIVESC_SOURCES) -> Column:
    kind = F.when(source.isin(*privesc), F.lit("privesc")).otherwise(source_type)
    return F.create_map(F.lit("source"), source, F.lit("type"), kind)


def flat_tags(tags: Column | str) -> Column:
    """``k:v`` pairs in key order, joined by commas."""
    pairs = F.array_sort(F.map_entries(tx.col(tags)))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


# ---------------------------------------------------------------- chunking
def chunk_fixed(
    df: DataFrame,
    content: str = "text",
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
    min_chars: int = rules.CHUNK_MIN_CHARS,
) -> DataFrame:
    """Overlapping chunks: ``start`` (0-based) and ``content``, stripped, longer than ``min_chars``.

    The text is cut once into steps and each chunk is one step plus the head of the
    following ones, so the cost stays linear in the text.
    """
    step = size - overlap
    ahead = -(-overlap // step)

    def chunk(parts: Column) -> Column:
        def at(part: Column, i: Column) -> Column:
            tail = F.array_join(F.slice(parts, i + 2, F.lit(ahead)), "")
            return F.struct((i * step).cast("long").alias("start"), tx.strip(F.concat(part, F.left(tail, F.lit(overlap)))).alias("content"))

        return F.filter(F.transform(parts, at), lambda s: F.length(s["content"]) > min_chars)

    parts = F.regexp_extract_all(tx.strip(tx.text_or_empty(content)), F.lit("(?s)(.{1,%d})" % step), F.lit(1))
    rest = [c for c in df.columns if c not in (content, "start", "content")]
    return df.select(*rest, F.explode(tx.let(parts, chunk)).alias("_c")).select(
        *rest, F.col("_c.start").alias("start"), F.col("_c.content").alias("content")
    )


def markdown_sections(
    df: DataFrame, content: str = "text", title: str = "title", min_chars: int = rules.SECTION_MIN_CHARS
) -> DataFrame:
    """One row per section in front of each H2/H3, titled ``T > H``."""
    parts = F.split(clean_text(content), r"(?m)(?=^##\s+)|(?=^###\s+)")
    keep = F.filter(F.transform(parts, tx.strip), lambda s: F.length(s) >= min_chars)
    rest = [c for c in df.columns if c not in (content, title)]
    heading = F.nullif(tx.strip(F.regexp_extract(F.col("content"), r"^#{2,3}[ \t]+([^\n]+)", 1)), F.lit(""))
    return df.select(*rest, F.col(title).alias("_t"), F.posexplode(keep).alias("chunk_no", "content")).select(
        *rest, "chunk_no", F.concat_ws(" > ", "_t", heading).alias("title"), "content"
    )


def _heading(marks: str) -> str:
    """The line break in front of a heading with a name."""
    return rf"(?Ud)\n(?={marks}[^\S\n][^\n]*\S)"


def markdown_breadcrumbs(
    df: DataFrame,
    content: str = "text",
    title: str = "title",
    min_chars: int = rules.BREADCRUMB_MIN_CHARS,
) -> DataFrame:
    """Sections by heading path.

    Text in front of the first H2 belongs to the first H2 section, the intro of an H2 to
    its first H3 section, and a text without H2 is one section under its title.

    A text is split at its H2 lines and each piece at its H3 lines, in its own row and in
    time linear in its length.
    """
    body = tx.text_or_empty(content)

    def name(piece: Column, marks: str) -> Column:
        return tx.strip(F.regexp_extract(piece, rf"(?Ud)^{marks}\s+([^\n]+)", 1))

    def section(h2: Column, h3: Column, text: Column) -> Column:
        return F.struct(h2.alias("h2"), h3.alias("h3"), text.alias("body"))

    def nothing() -> Column:
        return F.lit(None).cast("string")

    def by_h3(piece: Column, lead: Column) -> Column:
        """Sections of one H2 piece; ``lead`` (null: none) stands in front of the first."""
        h2 = name(piece, "##")

        def cut(subs: Column) -> Column:
            second = F.get(subs, F.lit(1))
            first = section(h2, F.when(second.isNotNull(), name(second, "###")).otherwise(nothing()), F.concat_ws("\n", lead, F.get(subs, F.lit(0)), second))
            more = F.transform(F.slice(subs, 3, F.greatest(F.size(subs), F.lit(1))), lambda p: section(h2, name(p, "###"), p))
            return F.concat(F.array(first), more)

        return tx.let(F.split(piece, _heading("###")), cut)

    def by_h2(pieces: Column) -> Column:
        titled = F.get(pieces, F.lit(0)).rlike(_heading("##").replace(r"\n(?=", "^(?=", 1))
        lead = F.when(~titled, F.get(pieces, F.lit(0)))
        own = F.slice(pieces, F.when(titled, 1).otherwise(2), F.size(pieces))
        cut = F.flatten(F.transform(own, lambda p, i: by_h3(p, F.when(i == 0, lead))))
        return F.when(F.size(own) > 0, cut).otherwise(F.array(section(nothing(), nothing(), F.get(pieces, F.lit(0)))))

    sections = F.filter(tx.let(F.split(body, _heading("##")), by_h2), lambda x: F.length(tx.strip(x["body"])) >= min_chars)
    rest = [c for c in df.columns if c not in (content, title)]
    return df.select(*rest, F.col(title).alias("_t"), F.posexplode(sections).alias("chunk_no", "_s")).select(
        *rest,
        "chunk_no",
        F.concat_ws(" > ", "_t", F.col("_s.h2"), F.col("_s.h3")).alias("breadcrumb"),
        F.col("_s.body").alias("content"),
    )


def code_chunks(df: DataFrame, content: str = "text", path: str = "path") -> DataFrame:
    """One chunk per fenced block below the front matter; without fences the cleaned body."""
    whole = tx.text_or_empty(content)
    has_front = whole.startswith("---\n") & whole.contains("\n---\n")
    cut = F.locate("\n---\n", whole)
    front = F.when(has_front, F.left(whole, cut - 1)).otherwise("")
    body = F.when(has_front, F.substring(whole, cut + 5, F.length(whole))).otherwise(whole)
    named = F.regexp_extract(F.col("_front"), r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    name = F.when(named != "", named).otherwise(F.upper(file_stem(path)))
    fences = F.regexp_extract_all(F.col("_body"), F.lit("(?s)" + rules.CODE_FENCE), F.lit(1))
    blocks = F.filter(F.transform(fences, tx.strip), lambda b: b != "")
    wrapped = F.transform(blocks, lambda b: fenced_entry(F.col("_name"), b))
    plain = F.filter(F.array(clean_text("_body")), lambda b: b != "")
    rest = [c for c in df.columns if c != content]
    return (
        df.withColumns({"_front": front, "_body": body})
        .withColumns({"_name": name, "_stem": file_stem(path)})
        .select(*rest, "_name", "_stem", F.posexplode(F.when(F.size(fences) > 0, wrapped).otherwise(plain)).alias("chunk_no", "content"))
        .select(
            *rest, "chunk_no", F.concat("_name", F.lit(" abuse")).alias("title"),
            F.concat(F.lit("https://gtfobins.github.io/gtfobins/"), "_stem", F.lit("/")).alias("url"), "content",
        )
    )


def fenced_entry(name: Column, code: Column) -> Column:
    return F.concat(F.lit("Binary Name: "), name, F.lit("\nAbuse Code:\n```bash\n"), code, F.lit("\n```"))


def field_chunks(
    df: DataFrame, payload: str = "payload", path: str = "path", fields: Sequence[str] = rules.ENTRY_FIELDS
) -> DataFrame:
    """Entries in JSON rows: every text (or list of texts) under ``fields``; else all text fields joined."""
    entry = F.from_json(F.col(payload), "map<string,string>")

    def texts(key: str) -> Column:
        raw = F.try_element_at(F.col("_m"), F.lit(key))
        as_list = F.from_json(raw, "array<string>")
        is_list = F.coalesce(raw.startswith("["), F.lit(False))
        one = F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.array(raw))
        return F.when(is_list & as_list.isNotNull(), as_list).otherwise(one)

    cand = F.filter(F.transform(F.flatten(F.array(*[texts(k) for k in fields])), tx.strip), lambda v: v != "")
    scalars = F.filter(F.map_entries("_m"), lambda e: (tx.strip(e["value"]) != "") & ~e["value"].rlike(r"^[\[{]"))
    joined = F.array_join(F.transform(scalars, lambda e: F.concat(e["key"], F.lit(": "), tx.strip(e["value"]))), "\n")
    fallback = F.when(joined != "", F.array(joined)).otherwise(F.array().cast("array<string>"))
    name = F.coalesce(
        F.nullif(F.try_element_at(F.col("_m"), F.lit("name")), F.lit("")),
        F.nullif(F.try_element_at(F.col("_m"), F.lit("binary")), F.lit("")),
        file_stem(path),
    )
    rest = [c for c in df.columns if c != payload]
    return (
        df.withColumn("_m", entry)
        .withColumn("_cand", cand)
        .withColumn("_name", tx.strip(name))
        .select(*rest, "_name", F.posexplode(F.when(F.size("_cand") > 0, F.col("_cand")).otherwise(fallback)).alias("chunk_no", "_code"))
        .select(
            *rest, "chunk_no", F.concat(F.upper("_name"), F.lit(" abuse")).alias("title"),
            F.concat(F.lit("https://gtfobins.github.io/gtfobins/"), F.lower("_name"), F.lit("/")).alias("url"),
            fenced_entry(F.upper("_name"), F.col("_code")).alias("content"),
        )
    )


def row_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    line: str,
    tag: str,
    first: Sequence[str] = (),
    at: str = "timestamp_seconds",
    window: int = rules.ROW_WINDOW,
    stride: int = rules.ROW_STRIDE,
) -> DataFrame:
    """Overlapping windows of rows inside a group.

    Windows start at 0, stride, 2*stride ... up to the first that reaches the end of
    its group.  Every row names the few windows it lies in, so the grouping key is
    (group, window) and no group is held as a whole.
    """
    keys = list(keys)
    numbered = with_position(df, keys, order, bucket, total="_total")
    lowest = F.greatest(F.lit(0), F.ceil((F.col("pos") - window + 1) / stride) * stride).cast("long")
    starts = F.sequence(lowest, F.floor(F.col("pos") / stride).cast("long") * stride, F.lit(stride).cast("long"))
    last_start = F.greatest(F.lit(0), F.ceil((F.col("_total") - window) / stride) * stride).cast("long")
    spread = (
        numbered.withColumn("_starts", F.filter(F.when(F.col("pos") >= lowest, starts), lambda s: s <= last_start))
        .withColumn("window_start", F.explode("_starts"))
    )
    text = tx.strip(tx.text_or_empty(line))
    tags = tx.strip(tx.text_or_empty(tag))
    rows = F.array_sort(F.collect_list(F.when(text != "", F.struct("pos", text.alias("line")))))
    return (
        spread.groupBy(*keys, "window_start")
        .agg(
            *[F.min_by(c, "pos").alias(c) for c in first],
            F.min(at).alias("min_ts"),
            F.max(at).alias("max_ts"),
            F.count(F.lit(1)).alias("n_rows"),
            F.array_join(F.array_sort(F.collect_set(F.when(tags != "", tags))), ", ").alias("tags"),
            F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["line"])), "\n").alias("lines"),
        )
    )


def walkthrough_documents(windows: DataFrame) -> DataFrame:
    """Content text of walkthrough windows in fixed line order, with a stable id per window."""

    def opt(label: str, c: str) -> Column:
        return F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))

    content = F.concat_ws(
        "\n",
        F.concat(F.lit("machine: "), "machine"),
        F.concat(F.lit("source_machine: "), "machine_raw"),
        F.concat(F.lit("phase: "), "phase"),
        F.concat(F.lit("title: "), "title"),
        opt("tag: ", "tags"),
        opt("academy: ", "academy"),
        opt("video_id: ", "video_id"),
        F.concat(F.lit("timestamp_seconds: "), F.col("min_ts").cast("string")),
        F.concat(F.lit("timestamp_end_seconds: "), F.col("max_ts").cast("string")),
        opt("line: ", "lines"),
        F.nullif(F.col("url"), F.lit("")),
    )
    return windows.withColumn("content", tx.strip(content))


def normalise_walkthrough(df: DataFrame) -> DataFrame:
    """Typed columns of raw walkthrough entries (see ``sources.walkthrough`` for the schema)."""

    def clean(c: str) -> Column:
        return tx.strip(tx.text_or_empty(c))

    raw = F.coalesce("machine", "name", F.lit("unknown"))
    bare = tx.strip(raw)
    cut = len(rules.MACHINE_PREFIX)
    name = F.when(F.lower(bare).startswith(rules.MACHINE_PREFIX), F.substring(bare, cut + 1, 1 << 30)).otherwise(bare)
    seconds = F.greatest(
        F.lit(0),
        F.coalesce(F.col("timestamp.minutes"), F.lit(0)) * 60 + F.coalesce(F.col("timestamp.seconds"), F.lit(0)),
    ).cast("long")
    given = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("link"), F.lit("")), F.lit(""))
    video = F.concat(
        F.lit("https://www.youtube.com/watch?v="), clean("videoId"), F.lit("&t="), seconds.cast("string"), F.lit("s")
    )
    return df.select(
        "idx",
        tx.squeeze(name).alias("machine"),
        raw.alias("machine_raw"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit("walkthrough")).alias("title"),
        F.when((given == "") & (clean("videoId") != ""), video).otherwise(given).alias("url"),
        clean("line").alias("line"),
        clean("tag").alias("tag"),
        clean("academy").alias("academy"),
        clean("videoId").alias("video_id"),
        seconds.alias("timestamp_seconds"),
        tx.first_group(F.lower(clean("line")), rules.WALKTHROUGH_PHASES, rules.WALKTHROUGH_PHASE_DEFAULT).alias("phase"),
    )


# ---------------------------------------------------------------- pages
def page_text(df: DataFrame, html: str = "html", min_words: int = rules.PAGE_MIN_WORDS, fit_chars: int = rules.PAGE_FIT_MIN_CHARS) -> DataFrame:
    """Title, all text, block-filtered text and the text used for retrieval of raw pages."""
    block_end = r"(?i)</(?:p|div|li|h[1-6]|td|tr|section|article|title)>|<br\s*/?>"
    dropped = F.regexp_replace(tx.text_or_empty(html), r"(?s)<!--.*?-->", " ")
    for tag in rules.PAGE_DROP_TAGS:
        dropped = F.regexp_replace(dropped, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    dropped = F.regexp_replace(dropped, r"(?is)<title(?:\s[^>]*)?>.*?</title>", " ")
    marked = F.regexp_replace(F.regexp_replace(dropped, r"\s+", " "), block_end, "\n")
    bare = unescape(F.regexp_replace(marked, r"(?s)<[^>]*>", " "))
    blocks = F.filter(F.transform(F.split(bare, "\n"), tx.squeeze), lambda b: b != "")
    title = tx.squeeze(unescape(F.regexp_extract(F.col(html), r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1)))
    fit = F.filter("_blocks", lambda b: F.size(F.split(b, " ")) >= min_words)
    use_fit = F.length("fit_text") > fit_chars
    return (
        df.withColumn("_blocks", blocks)
        .withColumns(
            {
                "title": F.when(title != "", title).otherwise(F.col("url")),
                "raw_text": F.array_join("_blocks", "\n"),
                "fit_text": F.array_join(fit, "\n"),
            }
        )
        .withColumns(
            {
                "text": F.when(use_fit, F.col("fit_text")).otherwise(F.col("raw_text")),
                "rag_source": F.when(use_fit | (F.col("fit_text") == F.col("raw_text")), "fit_markdown").otherwise("raw_markdown"),
            }
        )
        .drop("_blocks", html)
    )


def unescape(c: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def image_url(hits: DataFrame, key: str = "query_id", url: str = "url", content: str = "content", rank: str = "rank") -> DataFrame:
    """Per key the image address of the best-ranked hit that has one (own address first, then in its text)."""
    bare = tx.strip(tx.text_or_empty(url))
    path = F.lower(F.regexp_extract(bare, r"^https?://[^/?#]*([^?#]*)", 1))
    own = F.when(F.lower(bare).rlike(r"^https?://") & any_suffix(path, rules.IMAGE_SUFFIXES), bare)
    inside = tx.extract_or_null(
        tx.text_or_empty(content), r"(?i)(https?://[^\s\]\)>'\"]+\.(?:png|jpg|jpeg|webp|bmp|gif)(?:\?[^\s\]\)>'\"]*)?)"
    )
    found = hits.withColumn("_img", F.coalesce(own, inside)).filter(F.col("_img").isNotNull())
    return found.groupBy(key).agg(F.min_by("_img", rank).alias("image_url"))


def any_suffix(c: Column, suffixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for suffix in suffixes:
        out = out | c.endswith(suffix)
    return out


def last_code_block(c: Column | str) -> Column:
    blocks = F.regexp_extract_all(tx.text_or_empty(c), F.lit("(?s)" + rules.CODE_FENCE), F.lit(1))
    return tx.strip(F.try_element_at(blocks, F.lit(-1)))


def fence_commands(c: Column | str) -> Column:
    """Wrap runs of command-like lines in a code fence; texts with a fence stay as they are."""
    body = tx.strip(F.replace(tx.text_or_empty(c), F.lit("\r\n"), F.lit("\n")))
    pattern = r"^(?:\$\s*)?(?:sudo\s+)?(?:" + "|".join(rules.PROBABLE_COMMANDS) + r")\b"

    def judged(line: Column) -> Column:
        bare = tx.strip(line)
        shown = F.when(bare.startswith("$ "), F.substring(bare, 3, 1 << 30)).otherwise(bare)
        yes = F.struct(F.lit(True).alias("cmd"), shown.alias("shown"))
        no = F.struct(F.lit(False).alias("cmd"), line.alias("shown"))
        return F.when((bare != "") & bare.rlike(pattern), yes).otherwise(no)

    def fenced(rows: Column) -> Column:
        """A fence opens or closes where a line differs in kind from the one before."""

        def one(row: Column, i: Column) -> Column:
            before = (i > 0) & F.get(rows, i - 1)["cmd"]
            mark = F.when(row["cmd"] & ~before, "```bash\n").when(~row["cmd"] & before, "```\n").otherwise("")
            return F.concat(mark, row["shown"])

        end = F.when(F.element_at(rows, -1)["cmd"], "\n```").otherwise("")
        return tx.strip(F.concat(F.array_join(F.transform(rows, one), "\n"), end))

    done = tx.let(F.transform(tx.lines(body), judged), fenced)
    return F.when(body == "", "_No response yet._").when(body.contains("```"), body).otherwise(
        F.coalesce(F.nullif(done, F.lit("")), body)
    )


# ---------------------------------------------------------------- keys
def with_doc_key(df: DataFrame, *fields: str, content: str = "content", out: str = "doc_key", chars: int = 24) -> DataFrame:
    """Content key over ``fields`` and the first characters of the content."""
    parts = [F.col(f) for f in fields] + [F.col(content)]
    return df.withColumn(out, tx.content_key(*parts, chars=chars))


def distinct_by_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order (an upsert keeps the latest write).

    A grouped ``max_by`` combines on the map side, so many copies of one document
    meet in one task only as one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col("_best")[c].alias(c) for c in df.columns])
