"""What the tools and pages of the library show: ranked pools, details, lists and answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import playback_action

# Default and cap of results per surface, fields of search output, kinds shown in place, and gates of faces.
LIMITS = {"cli": (10, None), "server": (24, 60), "tool": (10, 50), "grid": (48, 48)}
FIELDS = ("asset_id", "ts", "score", "speech", "path")
INLINE = ("image/jpeg", "image/png", "image/gif", "image/webp")
INLINE_BYTES = 26_214_400
PHOTO_GATE, VIDEO_GATE = (0.6, 32), (0.7, 48)


def limit_for(surface: str, asked: int | None) -> int:
    """Results that a surface gives: its default, or what is asked up to its cap."""
    default, cap = LIMITS[surface]
    n = default if asked is None else max(1, asked)
    return n if cap is None else min(n, cap)


def check_fields(fields: str) -> list[str]:
    """Comma-separated output fields; an unknown one is an error."""
    names = [f.strip() for f in fields.split(",")]
    unknown = [f for f in names if f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}, of {FIELDS}")
    return names


def pool(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Image vectors and frame vectors as one pool; ts_secs is null for images."""
    return images.select("asset_id", F.lit(None).cast("double").alias("ts_secs"), "vector").unionByName(frames.select("asset_id", F.col("ts_secs").cast("double").alias("ts_secs"), "vector"))


def visible(assets: DataFrame) -> DataFrame:
    """Assets of a known kind."""
    return assets.where("mime_type is not null")


def hydrate(ranked: DataFrame, assets: DataFrame) -> DataFrame:
    """ranked(asset_id, rank, ...) with the visible assets' columns, in rank order."""
    return visible(assets).join(ranked, "asset_id").orderBy("rank")


def by_id(assets: DataFrame, asset_id: int | str, column: str = "asset_id") -> DataFrame:
    """The row of an id or, by column, of a hash."""
    return assets.where(F.col(column) == asset_id)


def inline(mime: Column, size: Column) -> Column:
    """Whether a browser is given the file in place: a listed kind of at most 25 MiB."""
    return F.coalesce(mime.isin(*INLINE) & (size <= INLINE_BYTES), F.lit(False))


def good_face(score: Column, width: Column, height: Column, video: bool) -> Column:
    """Whether a face passes the gates of photos or of video frames."""
    least, side = VIDEO_GATE if video else PHOTO_GATE
    return F.coalesce((score >= least) & (F.greatest(width, height) >= side), F.lit(False))


def face_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box of a face cut to its image."""
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.least(x + w, width) - left, F.lit(0.0)).alias("w"), F.greatest(F.least(y + h, height) - top, F.lit(0.0)).alias("h"))


def face_focus(hits: DataFrame, faces: DataFrame, widths: DataFrame) -> DataFrame:
    """asset_id and focus: where across the frame its faces are, weighed by score; 0.5 without any (AG10, J25)."""
    per = faces.groupBy("asset_id").agg((F.sum((F.col("x") + F.col("w") / 2) * F.col("score")) / F.sum("score")).alias("at"))
    out = hits.select("asset_id").join(widths, "asset_id", "left").join(per, "asset_id", "left")
    return out.select("asset_id", F.coalesce(F.least(F.greatest(F.try_divide("at", "width"), F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("focus"))


def record_detections(faces: DataFrame, runs: DataFrame, found: DataFrame, looked_at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces with found appended, and the ledger with one row per asset looked at, faces or none (SNK6, ST2)."""
    n = found.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_faces"))
    now = looked_at.select("asset_id").distinct().join(n, "asset_id", "left").select("asset_id", F.coalesce("n_faces", F.lit(0)).cast("long").alias("n_faces"))
    return faces.unionByName(found, allowMissingColumns=True), runs.join(now, "asset_id", "left_anti").select("asset_id", "n_faces").unionByName(now)


def create_person(people: DataFrame, person_id: int) -> DataFrame:
    """People with an unnamed one appended (SNK13)."""
    new = people.sparkSession.createDataFrame([(person_id,)], "person_id long")
    return people.unionByName(new, allowMissingColumns=True)


def transcript(segments: DataFrame, asset_id: int) -> DataFrame:
    """Segments of one asset in order (SRC20, API6)."""
    return segments.where(F.col("asset_id") == asset_id).orderBy("ts_secs")


def split_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that must, and pairs that must not, be together (SRC21)."""
    return links.where("must_link").select("face_a", "face_b"), links.where("not must_link").select("face_a", "face_b")


def todo_thumbnails(assets: DataFrame) -> DataFrame:
    """Visible assets without thumbnails, by id."""
    return visible(assets).where("not coalesce(thumbnailed, false)").orderBy("asset_id")


def todo_playback(assets: DataFrame) -> DataFrame:
    """Videos without a playback copy that a browser can't play as they are, with what to do (J7, ALG23)."""
    rows = assets.where("mime_type like 'video/%' and playback_path is null").withColumn("action", playback_action(F.col("codec"), F.col("mime_type")))
    return rows.where("action <> 'none'").orderBy("asset_id")


def total_duration(slots: DataFrame, key: str) -> DataFrame:
    """key and the sum of its slots' seconds (AG19)."""
    return slots.groupBy(key).agg(F.sum("duration").alias("total"))


def pair_report(photos: DataFrame, videos: DataFrame) -> DataFrame:
    """Pairs of both kinds in one list, best first (S2, ALG2)."""
    kinds = [x.select(F.lit(k).alias("kind"), "a", "b", "score") for k, x in (("photo", photos), ("video", videos))]
    return kinds[0].unionByName(kinds[1]).orderBy(F.desc("score"), "kind", "a", "b")


def search_output(hits: DataFrame, fields: str, form: str = "tsv") -> DataFrame:
    """One line per hit of hits(rank, *FIELDS): fields by tabs, a JSON object, or path @ts (SNK19, X27)."""
    names = check_fields(fields)
    text = {"asset_id": F.col("asset_id").cast("string"), "ts": F.coalesce(F.format_string("%.1f", F.col("ts")), F.lit("")), "score": F.format_string("%.4f", F.col("score")), "speech": F.coalesce("speech", F.lit("")), "path": F.col("path")}
    if form == "tsv":
        line = F.concat_ws("\t", *[text[n] for n in names])
    elif form == "json":
        line = F.to_json(F.struct(*names))
    else:
        line = F.concat("path", F.when(F.col("ts").isNotNull(), F.concat(F.lit(" @"), F.format_string("%.1f", F.col("ts")))).otherwise(F.lit("")))
    return hits.select("rank", line.alias("line")).orderBy("rank")


def no_repeat(options: DataFrame, key: str, span: str, rank: str, value: str) -> DataFrame:
    """One value per span: the best-ranked that isn't the one before it, else the best (W9, ALG14).

    options(key, span, rank, value) hold a few options of each span. A key's spans fold in
    order in one row, so a row holds one project's spans.
    """
    per = options.groupBy(key, span).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))).alias("o"))
    folded = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(span).alias("s"), "o"))).alias("spans"))
    kind = f"array<struct<s:{options.schema[span].dataType.simpleString()},v:{options.schema[value].dataType.simpleString()}>>"

    def step(acc: Column, x: Column) -> Column:
        before = F.try_element_at(acc, F.lit(-1))["v"]
        fresh = F.filter(x["o"], lambda o: ~o["v"].eqNullSafe(before))
        pick = F.when(F.size(fresh) > 0, F.try_element_at(fresh, F.lit(1))["v"]).otherwise(F.element_at(x["o"], 1)["v"])
        return F.concat(acc, F.array(F.struct(x["s"].alias("s"), pick.alias("v"))))

    out = folded.select(key, F.explode(F.aggregate("spans", F.array().cast(kind), step)).alias("x"))
    return out.select(key, F.col("x.s").alias(span), F.col("x.v").alias(value))


def faces_in(faces: DataFrame, people: DataFrame) -> DataFrame:
    """asset_id, number of faces, and the names of its people in the order of their best face (API3)."""
    per = faces.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_faces"))
    best = faces.where("person_id is not null").groupBy("asset_id", "person_id").agg(F.max("score").alias("score")).join(people.select("person_id", "name"), "person_id")
    names = best.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "person_id", "name"))).alias("p"))
    return per.join(names, "asset_id", "left").select("asset_id", "n_faces", F.coalesce(F.array_join(F.transform("p", lambda x: x["name"]), ", "), F.lit("")).alias("people"))


def scene_answer(scenes: DataFrame) -> DataFrame:
    """asset_id and its cuts in order, with two decimals (API4, X25)."""
    return scenes.where("ts_secs >= 0").groupBy("asset_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("ts_secs")), lambda t: F.round(t, 2))).alias("scenes"))


def grid(assets: DataFrame, number: int, per_page: int = 48) -> DataFrame:
    """One page of the visible assets, newest first, with their total and the number of pages (API13, AG2, W10)."""
    seen = visible(assets)
    total = seen.agg(F.count(F.lit(1)).alias("total"))
    rows = seen.orderBy(F.desc("imported_at"), "asset_id").offset(max(0, number - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / per_page))


def cut_list(slots: DataFrame, key: str) -> DataFrame:
    """key, n from 1 and a JSON object per slot, seconds with two decimals, joint as style:secs (API12, X39)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("position"))
    joint = F.when(F.col("style").isNotNull(), F.concat("style", F.lit(":"), F.col("secs").cast("string")))
    obj = F.to_json(F.struct("n", "asset", F.round("start", 2).alias("start"), F.round("duration", 2).alias("duration"), joint.alias("transition")))
    return slots.withColumn("n", n).select(key, "n", obj.alias("slot"))


def detail(assets: DataFrame, asset_id: int, ts: float | None = None) -> DataFrame:
    """One visible asset with the source that a page plays: the file, its copy or none, at #t= where asked (API15)."""
    action = playback_action(F.col("codec"), F.col("mime_type"))
    at = F.lit("" if ts is None else f"#t={ts:g}")
    source = F.when(~F.col("mime_type").startswith("video/"), F.concat(F.lit("/raw/"), F.col("asset_id").cast("string"))).when(action == "none", F.concat(F.lit("/raw/"), F.col("asset_id").cast("string"), at)).when(F.col("playback_path").isNotNull(), F.concat(F.lit("/play/"), F.col("asset_id").cast("string"), at))
    return by_id(visible(assets), asset_id).select("asset_id", "mime_type", source.alias("source"))
