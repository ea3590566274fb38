"""Timeline planning: spans on the beat, slots from ranked hits, structured edits and exports."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of clips and photos, share of the top score, shortest beat span, speech spans, joints.
CLIP_MIN, CLIP_MAX, LEAD, PHOTO_SECS, STRONG, SPAN_MIN = 0.5, 4.0, 1.5, 3.0, 0.35, 0.6
SPEECH_MIN, SPEECH_MAX, CROSSFADE, RETIME_MIN = 2.5, 8.0, 0.5, 0.3


@dataclass
class Hit:
    """A ranked search hit; ts is null for a photo, scenes are the cuts of a video."""

    asset: str
    score: float
    ts: float | None = None
    duration: float | None = None
    scenes: list[float] = field(default_factory=list)
    faces: int = 0


@dataclass
class Slot:
    """A place in the timeline; joint is the transition into it."""

    asset: str
    kind: str
    start: float
    duration: float
    media: float | None = None
    joint: tuple[str, float] | None = None
    pinned: bool = False


def strong_prefix(hits: list[Hit]) -> list[Hit]:
    """Leading hits with a positive score of at least 0.35 of the first one's."""
    out: list[Hit] = []
    for h in hits:
        if h.score <= 0 or h.score < STRONG * max(hits[0].score, 0.0):
            break
        out.append(h)
    return out


def shot_of(hit: Hit) -> tuple[float, float]:
    before, after = [s for s in hit.scenes if s <= hit.ts], [s for s in hit.scenes if s > hit.ts]
    return max(before, default=0.0), min(after, default=hit.duration if hit.duration is not None else math.inf)


def clip_bounds(hit: Hit) -> tuple[float, float]:
    """(start, length) of a clip about a hit, inside its shot (ALG11)."""
    a, b = shot_of(hit)
    start = max(hit.ts - LEAD, a)
    return start, min(max(b - start, CLIP_MIN), CLIP_MAX)


def plan(hits: list[Hit], target: float) -> list[Slot]:
    """Slots of the strong hits in order until one would overrun; at least one (ALG9, W3, G7)."""
    out: list[Slot] = []
    total = 0.0
    for h in strong_prefix(hits):
        start, length = (0.0, PHOTO_SECS) if h.ts is None else clip_bounds(h)
        if out and total + length > target:
            break
        out.append(Slot(h.asset, "photo" if h.ts is None else "video", start, length, h.duration))
        total += length
    return out


def is_hot(t: float, loud: list[tuple[float, float]]) -> bool:
    return any(a <= t < b for a, b in loud)


def beat_spans(beats: list[float], loud: list[tuple[float, float]], total: float) -> list[tuple[float, float]]:
    """Spans of four beats, two where it is loud, of at least 0.6 s; the lead-in joins the first (ALG8)."""
    out: list[tuple[float, float]] = []
    i, n = 0, len(beats)
    while i < n and beats[i] < total:
        j = min(i + (2 if is_hot(beats[i], loud) else 4), n)
        while j < n and beats[j] - beats[i] < SPAN_MIN:
            j += 1
        end = min(beats[j] if j < n else total, total)
        if end - beats[i] >= SPAN_MIN or not out:
            out.append((beats[i], end))
        i = j
    return [(0.0, out[0][1]), *out[1:]] if out else []


def fill_span(hit: Hit, length: float) -> Slot:
    """A slot of a wanted length about a hit (ALG11, G21)."""
    if hit.ts is None:
        return Slot(hit.asset, "photo" if hit.faces else "photo_scenic", 0.0, length, hit.duration)
    media = hit.duration if hit.duration is not None else math.inf
    got = min(length, media)
    shot = shot_of(hit)[0]
    whole = media - shot >= got and hit.ts - shot <= got
    start = shot if whole else min(max(hit.ts - got / 2, 0.0), max(media - got, 0.0))
    return Slot(hit.asset, "video", start, got, hit.duration)


def plan_synced(hits: list[Hit], beats: list[float], loud: list[tuple[float, float]], total: float) -> list[Slot]:
    """Best hits on the drops, the others in order; crossfades where the energy flips (ALG10, W7, W8)."""
    pool, spans = strong_prefix(hits), beat_spans(beats, loud, total)
    n = min(len(pool), len(spans))
    hot = [is_hot((a + b) / 2, loud) for a, b in spans[:n]]
    drops = [i for i in range(n) if hot[i] and (i == 0 or not hot[i - 1])]
    order = drops + [i for i in range(n) if i not in set(drops)]
    chosen = dict(zip(order, pool, strict=False))
    out: list[Slot] = []
    at = 0.0
    for i in range(n):
        slot = fill_span(chosen[i], spans[i][1] - at)
        if i and hot[i] != hot[i - 1]:
            slot.joint = ("crossfade", CROSSFADE)
        out.append(slot)
        at += slot.duration
    return out


def speech_spans(segments: list[tuple[float, float, str]], total: float) -> list[tuple[float, float, str]]:
    """Spans of at least 2.5 s over spoken segments, long ones cut evenly, covering total (ALG12)."""
    out: list[tuple[float, float, str]] = []
    start, i = 0.0, 0
    while i < len(segments) and start < total:
        end, words = segments[i][1], [segments[i][2]]
        while end - start < SPEECH_MIN and i + 1 < len(segments):
            i += 1
            end = segments[i][1]
            words.append(segments[i][2])
        i += 1
        end = max(min(end, total), start + min(SPEECH_MIN, total - start))
        parts = max(1, math.ceil((end - start) / SPEECH_MAX))
        cut = (end - start) / parts
        out += [(start + k * cut, start + (k + 1) * cut, " ".join(words)) for k in range(parts)]
        start = end
    if out:
        out[-1] = (out[-1][0], total, out[-1][2])
    return out


def variation(pool: list[Hit], number: int) -> list[Hit]:
    """The pool turned by number - 1 places (ALG13)."""
    k = (number - 1) % len(pool) if pool else 0
    return pool[k:] + pool[:k]


class EditError(ValueError):
    """An edit batch that can't be applied; the timeline stays as it was."""


def apply_ops(slots: list[Slot], ops: list[dict], candidates: dict[int, list[Hit]] | None = None, sharp: set[str] | None = None) -> list[Slot]:
    """A batch of edits, numbered from 1 on the given slots (ALG15, S4).

    Ranges and values are checked before anything changes. Pins come first, then unpins, retime,
    transition, swap, drop and reorder. candidates gives the hits for each swap; a swap
    takes the first positive unused sharp one of ten, else unused, else positive.
    """
    n = len(slots)
    new = copy.deepcopy(slots)
    for op in ops:
        if "slot" in op and not 1 <= op["slot"] <= n:
            raise EditError(f"no slot {op['slot']}")
        if op["op"] == "retime" and op["secs"] < RETIME_MIN:
            raise EditError("too short")
    orders = [op["order"] for op in ops if op["op"] == "reorder"]
    if len(orders) > 1:
        raise EditError("more than one reorder")
    by = lambda kind: [op for op in ops if op["op"] == kind]
    for kind in ("pin", "unpin"):
        for op in by(kind):
            new[op["slot"] - 1].pinned = kind == "pin"
    dropped = {op["slot"] for op in by("drop")}
    if any(new[k - 1].pinned for k in dropped):
        raise EditError("a pinned slot can't be dropped")
    for op in by("retime"):
        s = new[op["slot"] - 1]
        room = max(RETIME_MIN, s.media - s.start) if s.kind == "video" and s.media is not None else op["secs"]
        s.duration = min(op["secs"], room)
    for op in by("transition"):
        if op["slot"] > 1:
            new[op["slot"] - 1].joint = None if op["style"] == "cut" else (op["style"], op["secs"])
    used = {s.asset for s in new}
    for op in by("swap"):
        k = op["slot"] - 1
        if new[k].pinned:
            raise EditError("a pinned slot can't be swapped")
        hits = [h for h in (candidates or {}).get(op["slot"], [])[:10] if h.score > 0]
        fresh = [h for h in hits if h.asset not in used]
        pick = next((h for h in fresh if sharp is None or h.asset in sharp), None) or next(iter(fresh), None) or next(iter(hits), None)
        if pick is None:
            raise EditError("nothing to swap in")
        joint, length = new[k].joint, new[k].duration
        new[k] = fill_span(pick, length)  # no longer than its media
        new[k].joint, new[k].pinned = joint, False
        used.add(pick.asset)
    left = [k for k in range(1, n + 1) if k not in dropped]
    if orders:
        if sorted(orders[0]) != left:
            raise EditError("the order must name each slot that stays once")
        left = orders[0]
    if not left:
        raise EditError("nothing would be left")
    return [new[k - 1] for k in left]


VERSION = 1


def save_project(slots: list[Slot], **more) -> str:
    """The project document as JSON (SNK14)."""
    return json.dumps({"version": VERSION, **more, "slots": [asdict(s) for s in slots]}, indent=2)


def load_project(text: str) -> list[Slot]:
    """Slots of a project document; a newer version is refused (SRC16)."""
    doc = json.loads(text)
    if doc.get("version", 1) > VERSION:
        raise ValueError(f"project version {doc['version']} is newer than {VERSION}")
    return [Slot(**{**s, "joint": tuple(s["joint"]) if s.get("joint") else None}) for s in doc["slots"]]


def export_otio(name: str, slots: list[Slot], rate: float = 30.0) -> dict:
    """The timeline in the interchange schema: one track of clips in frames (SNK15, X28)."""
    time = lambda secs: {"OTIO_SCHEMA": "RationalTime.1", "value": math.floor(secs * rate + 0.5), "rate": rate}
    clip = lambda s: {
        "OTIO_SCHEMA": "Clip.2", "name": s.asset, "source_range": {"OTIO_SCHEMA": "TimeRange.1", "start_time": time(s.start), "duration": time(s.duration)},
        "media_references": {"DEFAULT_MEDIA": {"OTIO_SCHEMA": "ExternalReference.1", "target_url": s.asset}}, "active_media_reference_key": "DEFAULT_MEDIA",
    }
    track = {"OTIO_SCHEMA": "Track.1", "name": "V1", "kind": "Video", "children": [clip(s) for s in slots]}
    return {"OTIO_SCHEMA": "Timeline.1", "name": name, "tracks": {"OTIO_SCHEMA": "Stack.1", "name": "tracks", "children": [track]}}


def running_plan(hits: DataFrame, key: str, target: float) -> DataFrame:
    """hits(key, rank, duration) up to the running total target, at least the first, with offsets.

    The set form of plan for many timelines at once: a windowed sum per key; as durations
    are positive, stopping at the first overrun is the prefix within target.
    """
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("total", F.sum("duration").over(w)).where((F.col("total") <= target) | (F.col("rank") == 1)).withColumn("offset", F.col("total") - F.col("duration"))


def sharp_enough(hits: DataFrame, key: str, floor: float = 12.0) -> DataFrame:
    """Hits at or over the floor; unmeasured ones pass, and all pass where none would."""
    ok = F.coalesce("sharpness", F.lit(float("inf"))) >= floor
    any_ok = F.max(ok.cast("int")).over(Window.partitionBy(key)) == 1
    return hits.withColumn("__ok", ok).withColumn("__any", any_ok).where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")
