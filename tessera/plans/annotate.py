"""The five annotation stages as DataFrame transforms with pluggable models.

A model is a callable from a list of values to a list (or, for the segmenter, lists
of boxes); it is built once a worker by its factory. Stand-ins below are deterministic.
A row whose model call fails keeps null there and stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.functions.image import crop
from tessera.operators.graphs import GRAPH
from tessera.operators.regions import crop_regions, slices

DETECTIONS = "array<array<struct<score:double,label:int>>>"


def mapped(df: DataFrame, factory: Callable[[], Callable], source: str, target: str, kind: str, batch: int = 8) -> DataFrame:
    """``df`` with ``target`` from a model over ``source``, in mini-batches; a failing batch is tried row by row."""
    names = df.columns
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in slices(batches, batch * max(1, 64 // batch)):
            out: list = []
            values = part.column(source).to_pylist()
            for at in range(0, len(values), batch):
                some = values[at : at + batch]
                try:
                    out += list(model(some))
                except Exception:  # noqa: BLE001  any model error: the batch goes again row by row
                    for value in some:
                        try:
                            out += list(model([value]))
                        except Exception:  # noqa: BLE001  the row keeps null
                            out.append(None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, made)], [*names, target])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), f"`{target}` {kind}"]))


def stand_in_captioner():
    words = ("red", "small", "bright", "wooden", "car", "tree", "house", "river")
    return lambda batch: [None if v is None else f"a {words[zlib.crc32(bytes(v)) % 4]} {words[4 + zlib.crc32(bytes(v)) // 7 % 4]}." for v in batch]


def stand_in_segmenter():
    def boxes(v):
        h = zlib.crc32(bytes(v))
        return [[(h >> k) % 500, (h >> (k + 3)) % 380, (h >> k) % 500 + 20 + k * 9, (h >> (k + 3)) % 380 + 15 + k * 7] for k in range(12)]

    return lambda batch: [None if v is None else boxes(v) for v in batch]


def stand_in_parser():
    """The last word before a break is a head, the words before it, articles apart, its attributes."""

    def graph(text):
        runs = [r.split() for r in re.findall(r"[a-z][a-z ]*", text.lower())]
        runs = [[w for w in r if w not in ("a", "an", "the", "and")] for r in runs]
        return {"entities": [{"head": r[-1], "quantity": None, "attributes": r[:-1]} for r in runs if r], "relations": []}

    return lambda batch: [None if v is None else [graph(t) for t in v] for v in batch]


def stand_in_detector():
    """One detection a phrase, its score a hash of the phrase."""
    return lambda batch: [None if v is None else [[{"score": zlib.crc32(p.encode()) % 100 / 100, "label": k} for k, p in enumerate(list(some))] for some in v["phrases"]] for v in batch]


def stand_in_decoder(frame: bytes, height: int, width: int) -> np.ndarray:
    return np.resize(np.frombuffer(frame, dtype=np.uint8), (height, width, 1))


def crop_captioner(captioner, decoder):
    """Captions of the pixels inside each box of an image; images are decoded and cropped in the worker."""

    def make():
        model = captioner()

        def run(batch):
            out = []
            for v in batch:
                if v is None or v["frame"] is None:
                    out.append(None)
                    continue
                pixels = decoder(bytes(v["frame"]), int(v["hw"][0]), int(v["hw"][1]))
                boxes = [[b[c] for c in ("x1", "y1", "x2", "y2")] for b in v["boxes"]]
                out.append(list(model([crop(pixels, b).tobytes() for b in boxes])) if boxes else [])
            return out

        return run

    return make


def best_scores(phrases: Column, detections: Column) -> Column:
    """Per phrase the best score of the detections of its label, 0 without any; labels out of range meet no phrase."""
    found = lambda k: F.transform(F.filter(detections, lambda d: d["label"] == k), lambda d: d["score"])
    return F.transform(phrases, lambda _, k: F.coalesce(F.array_max(found(k)), F.lit(0.0)))


def grounding_filter(rows: DataFrame, parser=stand_in_parser, detector=stand_in_detector, threshold: float = 0.3, frame: str = "frame") -> DataFrame:
    """Adds ``filtered_overall_caption`` and ``filtered_local_captions``: captions without the phrases no detection supports.

    Local captions lose each head without attribute, with the letters that touch it; the
    caption itself is one more label, which competes with the phrases and is never cut.
    Sentences of the overall caption lose each phrase literally and are joined again. A
    row whose parser or detector fails, or without a caption, keeps its captions.
    """
    local = F.coalesce("local_captions", F.array().cast(rows.schema["local_captions"].dataType))
    work = rows.withColumn("__local", F.transform(local, lambda s: F.coalesce(s["caption"], F.lit("")))).withColumn("__sentences", T.sentences(F.col("overall_caption")))
    work = work.withColumn("__texts", F.concat("__local", "__sentences"))
    work = mapped(work, parser, "__texts", "__graphs", f"array<{GRAPH}>")
    heads = lambda g: F.transform(g["entities"], lambda e: e["head"])
    pairs = lambda g, name: F.flatten(F.transform(g["entities"], lambda e: F.transform(e["attributes"], lambda x: F.struct(e["head"].alias(name), x.alias("attribute")))))
    text = lambda k: F.get(F.col("__texts"), k)

    def phrases(g, k):
        own = F.concat(T.local_phrases(heads(g), pairs(g, "head"), text(k)), F.array(text(k)))
        whole = F.transform(T.sentence_phrases(heads(g), pairs(g, "noun"), text(k)), lambda p: p["phrase"])
        return F.when(k < F.size("__local"), own).otherwise(whole)

    work = work.withColumn("__phrases", F.transform("__graphs", phrases))
    work = work.withColumn("__asked", F.when(F.col("__phrases").isNotNull(), F.struct(F.col(frame).alias("frame"), F.col("__phrases").alias("phrases"))))
    work = mapped(work, detector, "__asked", "__found", DETECTIONS)
    # Phrases to cut from each text; the last label of a local caption is the caption.
    cut = lambda some, k: F.filter(F.when(k < F.size("__local"), F.slice(some, 1, F.size(some) - 1)).otherwise(some), lambda _, i: F.get(best_scores(some, F.get(F.col("__found"), k)), i) < threshold)
    work = work.withColumn("__cut", F.transform("__phrases", cut))
    done = F.col("__found").isNotNull()
    kept = F.transform(local, lambda s, k: F.struct(s["box"].alias("box"), F.when(done, T.without_runs(s["caption"], F.get(F.col("__cut"), k))).otherwise(s["caption"]).alias("caption")))
    overall = T.joined(F.transform("__sentences", lambda s, k: T.without_phrases(s, F.get(F.col("__cut"), k + F.size("__local")))))
    overall = F.when(F.col("overall_caption").isNull() | ~done, F.col("overall_caption")).otherwise(overall)
    return work.select(*rows.columns, overall.alias("filtered_overall_caption"), kept.alias("filtered_local_captions"))


def preferred(rows: DataFrame) -> tuple[Column, Column]:
    """The overall and the local captions to go on with: the filtered ones where both columns are there, else the raw ones."""
    names = ("filtered_overall_caption", "filtered_local_captions")
    return tuple(F.col(c) for c in (names if set(names) <= set(rows.columns) else ("overall_caption", "local_captions")))


def annotate(images: DataFrame, captioner=stand_in_captioner, segmenter=stand_in_segmenter, merger=None, frame: str = "frame", hw=(480, 640), parser=stand_in_parser, detector=stand_in_detector, decoder=stand_in_decoder, threshold: float = 0.3) -> DataFrame:
    """Overall caption; boxes and crops; local captions; captions filtered by detections; merge prompt or merged caption.

    Every input column passes through; the image is read by the model stages alone.
    ``parser`` or ``detector`` None leaves the fourth stage out.
    """
    rows = mapped(images, captioner, frame, "overall_caption", "string")
    rows = mapped(rows, segmenter, frame, "boxes", "array<array<long>>", batch=1).withColumn("hw", F.array(*[F.lit(v) for v in hw]))
    rows = crop_regions(rows).withColumn("hw", F.array(*[F.lit(v) for v in hw]))
    boxes = G.crops(F.transform("cropped", lambda b: G.box(*[b[k] for k in range(4)])), F.lit(hw[0]), F.lit(hw[1]))
    rows = rows.withColumn("local_boxes", boxes).withColumn("crops", F.struct(F.col(frame).alias("frame"), "hw", F.col("local_boxes").alias("boxes")))
    made = mapped(rows, crop_captioner(captioner, decoder), "crops", "local", "array<string>")
    made = made.withColumn("local_captions", F.arrays_zip(F.col("local_boxes").alias("box"), F.coalesce("local", F.transform("local_boxes", lambda _: F.lit(None).cast("string"))).alias("caption"))).drop("crops", "local", "local_boxes", "hw")
    if parser is not None and detector is not None:
        made = grounding_filter(made, parser, detector, threshold, frame)
    overall, local = preferred(made)
    prompt = T.merge_prompt(F.coalesce(overall, F.lit("")), F.transform(local, lambda s: s["caption"]))
    made = made.withColumn("merge_prompt", prompt)
    if merger is not None:
        made = mapped(made, merger, "merge_prompt", "synthesized_caption", "string", batch=4)
        made = made.withColumn("synthesized_caption", T.answer(F.col("synthesized_caption"), F.col("merge_prompt")))
    return made
