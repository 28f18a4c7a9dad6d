"""Meetings around the transcript: readiness, settings, media, metrics and summaries, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What blocks a session, what only takes recording away, what only takes translation away.
BLOCKING = ("runtime", "python", "recogniser", "model", "store", "output_device", "output_folder", "disk")
RECORDING = ("media_tools", "encoder", "capture_target")
TRANSLATION = ("translation_config", "translation_key")

#: Names of languages, and what stands for an unnamed owner or date.
LANGUAGE_NAMES = {"ja": "Japanese", "zh": "Simplified Chinese", "en": "English"}
NOT_SPECIFIED = {"ja": "未指定", "en": "Not specified"}
UNSPECIFIED = "未明确"

#: Limits of a summary's lists and texts.
MOST_ITEMS, MOST_CHARS = 200, 4_000


def preflight(reports: DataFrame, key: str = "id") -> DataFrame:
    """(key, errors, warnings, ready, recording, translation) from one boolean column for each check and `translate`.

    A failed blocking check is an error; recording and translation only warn. Media
    tools, encoder and target warn one by one, translation once and only if it is on.
    """
    failed = lambda c: (~F.coalesce(F.col(c), F.lit(False))).cast("int")
    total = lambda columns: sum((failed(c) for c in columns), F.lit(0))
    errors, media = total(BLOCKING), total(RECORDING)
    speaks = total(TRANSLATION) == 0
    on = F.coalesce(F.col("translate"), F.lit(False))
    return reports.select(key, errors.alias("errors"), (media + (on & ~speaks).cast("int")).alias("warnings"), (errors == 0).alias("ready"), (media == 0).alias("recording"), (on & speaks).alias("translation"))


def expired_logs(files: DataFrame, today: Column, days: int, name: str = "name") -> DataFrame:
    """The files app-YYYYMMDD….log whose date is more than `days` (one at least) before today; other names stay."""
    stamp = F.regexp_extract(name, r"^app-(\d{8})[^/]*\.log$", 1)
    dated = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return files.where(dated < F.date_sub(today, max(1, days)))


def loud(samples: DataFrame, keys: list[str], at: str, value: Column, window: int, threshold: float) -> DataFrame:
    """(keys, loud): whether any window of so many samples has this root mean square; a short moment isn't diluted."""
    windows = samples.groupBy(*keys, F.floor(F.col(at) / window).alias("w")).agg(F.sqrt(F.avg(value * value)).alias("rms"))
    return windows.groupBy(*keys).agg(F.bool_or(F.col("rms") >= threshold).alias("loud"))


def profiles_of(profiles: DataFrame, language: Column) -> DataFrame:
    """Profiles of a language with their place: built-in ones first, then by name."""
    order = Window.partitionBy("language").orderBy(F.desc("builtin"), F.lower("name"), "id")
    return profiles.where(F.col("language") == language).withColumn("place", F.row_number().over(order))


def active_profile(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """(language, id) for each row (language, active) of chosen: the chosen profile, if it exists, else the built-in one."""
    ids = profiles.select(F.col("id").alias("active"), F.lit(True).alias("known"))
    built_in = profiles.where("builtin").groupBy("language").agg(F.min("id").alias("own"))
    rows = chosen.join(ids, "active", "left").join(built_in, "language", "left")
    return rows.select("language", F.when(F.col("known"), F.col("active")).otherwise(F.col("own")).alias("id"))


def first_existing(candidates: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """(key, path): of the candidates (key, ord, path) the first whose path is among the files; null if none is."""
    there = candidates.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return there.groupBy(key).agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("ord"))).alias("path"))


def complete(needed: DataFrame, files: DataFrame, key: str = "model") -> DataFrame:
    """(key, complete): whether every needed (key, path, least) file exists with at least that size."""
    sizes = files.groupBy("path").agg(F.max("size").alias("size"))
    return needed.join(sizes, "path", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("size") >= F.col("least"), F.lit(False))).alias("complete"))


def visible_titles(windows: DataFrame, excluded: list[str]) -> DataFrame:
    """(title, handle): the first window of each title, blank and excluded titles (in any case) left out."""
    kept = windows.where((F.trim("title") != "") & ~F.lower("title").isin([e.lower() for e in excluded]))
    return kept.groupBy("title").agg(F.min_by("handle", "ord").alias("handle"))


def known_sum(column: str) -> Column:
    """Sum of the values that are there; null only if none is."""
    return F.sum(column)


def caption_metrics(cycles: DataFrame) -> DataFrame:
    """Per session: partial, final, empty and skipped cycles, audio by its fate, and the real-time factor.

    cycles has session, kind (partial, final, empty, skipped, discarded), audio_ms and busy_ms.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}s")
    audio = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("audio_ms"))), F.lit(0))
    heard = audio("partial", "final", "empty")
    return cycles.groupBy("session").agg(n("partial"), n("final"), n("empty"), n("skipped"), audio("final").alias("final_ms"), audio("discarded").alias("discarded_ms"), F.when(heard > 0, F.sum("busy_ms") / heard).alias("rtf"))


def recovery_counts(sessions: DataFrame) -> DataFrame:
    """One row: sessions recovered (they were left running), finished and failed."""
    state = F.col("state")
    return sessions.agg(F.count_if(state == "Running").alias("recovered"), F.count_if(state == "Completed").alias("completed"), F.count_if(~state.isin("Running", "Completed", "Recovered")).alias("stopped"), F.count("*").alias("sessions"))


def media_probe(probes: DataFrame, json: str = "json") -> DataFrame:
    """probes with duration, start, frame_rate and has_audio out of the media tool's JSON; what is missing or no number is null."""
    shape = "format struct<duration string>, streams array<struct<codec_type string, r_frame_rate string, start_time string>>"
    parsed = F.from_json(json, shape)
    video = F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    parts = F.split(video["r_frame_rate"], "/")
    number = lambda c: c.try_cast("double")
    rate = F.when((F.size(parts) == 2) & (number(F.get(parts, F.lit(1))) != 0), number(F.get(parts, F.lit(0))) / number(F.get(parts, F.lit(1))))
    audio = F.coalesce(F.exists(parsed["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False))
    return probes.withColumns({"duration": number(parsed["format"]["duration"]), "start": number(video["start_time"]), "frame_rate": rate, "has_audio": audio})


def gigabytes(size: Column) -> Column:
    return size / float(1 << 30)


def cpu_percent(busy_ms: Column, wall_ms: Column, cores: int) -> Column:
    """Share of all cores, 0 to 100; null without wall time."""
    return F.when(wall_ms > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * busy_ms / (wall_ms * cores))))


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(code)), code, F.lit("the source language"))


def not_specified(language: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in NOT_SPECIFIED.items() for x in pair])
    return F.coalesce(F.try_element_at(names, language), F.lit(UNSPECIFIED))


def can_summarise(busy: Column, finals: Column) -> Column:
    return ~busy & (finals >= 1)


def option_errors(options: DataFrame, rules: dict[str, tuple[float, float]], key: str = "id") -> DataFrame:
    """(key, option, message) for every option that is null or outside its bounds: all errors, not the first."""
    broken = [F.when(F.col(o).isNull() | ~F.col(o).between(lo, hi), F.struct(F.lit(o).alias("option"), F.lit(f"{o} must be from {lo} to {hi}").alias("message"))) for o, (lo, hi) in rules.items()]
    return options.select(key, F.explode(F.array_compact(F.array(*broken))).alias("x")).select(key, "x.option", "x.message")


def capped(items: Column) -> Column:
    """At most MOST_ITEMS texts of at most MOST_CHARS characters; null and blank ones left out."""
    fine = F.filter(items, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.transform(F.slice(fine, F.lit(1), F.lit(MOST_ITEMS)), lambda t: F.substring(t, 1, MOST_CHARS))


def summary_parts(parts: DataFrame, size: int) -> DataFrame:
    """(session, group, json): the parts (session, ord, points) of a summary in groups of `size`, 2 to 50, as JSON arrays."""
    size = min(50, max(2, size))
    place = F.row_number().over(Window.partitionBy("session").orderBy("ord")) - 1
    rows = parts.select("session", F.floor(place / size).alias("group"), "ord", capped(F.col("points")).alias("points"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", "points"))), lambda x: F.struct(x["points"].alias("points")))
    return rows.groupBy("session", "group").agg(F.to_json(own).alias("json"))


#: Sections of the two layouts; then, by language, the headings: title, line of an empty section, the
#: sections of each layout, the columns of action items, and the labels of what stands before the sections.
SECTIONS = {
    "single": ("overview", "topics", "key_points", "process_steps", "conclusions", "risks"),
    "group": ("overview", "topics", "key_points", "decisions", "action_items", "unresolved_questions", "risks"),
}
HEADINGS = {
    "en": ("English", "Meeting Summary", "No relevant content extracted.", {"single": "Overview|Topics|Key points|Process steps|Conclusions|Notes", "group": "Meeting overview|Discussion topics|Key opinions|Decisions|Action items|Unresolved questions|Risks and notes"}, "Task|Owner|Due", "Meeting type|Summary language|Segment count|Source: confirmed original captions", {"single": "Single presenter", "group": "Group discussion"}),
    "ja": ("日本語", "会議まとめ", "該当する内容は抽出されませんでした", {"single": "内容概要|主なトピック|重要ポイント|手順|結論|注意事項", "group": "会議概要|討論トピック|主な意見|決定事項|アクション項目|未解決の質問|リスクと注意事項"}, "項目|担当|期限", "会議形式|要約言語|字幕件数|データソース：確認済みの原文字幕", {"single": "単独説明", "group": "複数人ディスカッション"}),
    "zh": ("简体中文", "会议要点", "未提取到相关内容。", {"single": "内容概要|主要主题|关键知识点|操作流程|结论|注意事项", "group": "会议概述|讨论主题|主要观点|决定事项|待办事项|未解决问题|风险与注意事项"}, "事项|负责人|截止时间", "会议形式|摘要语言|字幕条数|数据来源：已确认的原文字幕", {"single": "单人讲解", "group": "多人讨论"}),
}


def summary_markdown(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(session, content): a heading, what the summary is of, and a section for each part of the layout.

    items has session, section, ord, text, owner, due; documents session, language
    (others count as zh), layout (single or group) and segments. Sections are bullets,
    action items a table; one without items says so. Pipes are escaped, line ends blanks.
    """
    plan = []
    for language, (own_name, title, none, heads, columns, labels, layouts) in HEADINGS.items():
        label = labels.split("|")
        for layout, sections in SECTIONS.items():
            before = f"# {title}\n\n- {label[0]}：{layouts[layout]}\n- {label[1]}：{own_name}\n- {label[2]}："
            for place, (section, head) in enumerate(zip(sections, heads[layout].split("|"))):
                plan.append((language, layout, place, section, before, f"\n- {label[3]}\n\n", none, f"## {head}\n\n", "| " + columns.replace("|", " | ") + " |\n|---|---|---|\n"))
    plan = documents.sparkSession.createDataFrame(plan, "language string, layout string, place int, section string, before string, source string, none string, head string, columns string")
    docs = documents.select("session", F.when(F.col("language").isin("en", "ja"), F.col("language")).otherwise("zh").alias("language"), "layout", "segments")
    plain = lambda c: F.replace(F.regexp_replace(c, r"[\r\n]", " "), F.lit("|"), F.lit("\\|"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lists = items.where(~blank(F.col("text"))).groupBy("session", "section").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "owner", "due"))).alias("items"))
    full = docs.join(F.broadcast(plan), ["language", "layout"]).join(lists, ["session", "section"], "left")
    missing = not_specified(F.col("language"))
    named = lambda c: F.when(blank(c), missing).otherwise(plain(c))
    table = F.concat("columns", F.array_join(F.transform("items", lambda x: F.concat(F.lit("| "), plain(x["text"]), F.lit(" | "), named(x["owner"]), F.lit(" | "), named(x["due"]), F.lit(" |"))), "\n"))
    bullets = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), plain(x["text"]))), "\n")
    body = F.when(F.col("items").isNull(), F.col("none")).when(F.col("section") == "action_items", table).otherwise(bullets)
    parts = full.select("session", F.concat("before", F.col("segments").cast("string"), "source").alias("before"), F.struct("place", F.concat("head", body, F.lit("\n\n")).alias("part")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "")
    return parts.groupBy("session", "before").agg(joined.alias("parts")).select("session", F.concat("before", "parts").alias("content"))
