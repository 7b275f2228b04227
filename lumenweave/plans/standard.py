"""All loaders of the catalog over named source tables, with the sizes of one ``Settings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lumenweave.catalog import Loader, Settings
from lumenweave.plans import loaders as L
from lumenweave.schema import SPLITS
from lumenweave.sources import write_records

#: (corpus, split) -> the source's tables by the names of the loader's parameters.
Tables = Callable[[str, str], dict[str, DataFrame]]
_TESTS = ("test", "teststd", "testdev")


def with_arguments(loader: Callable[..., DataFrame], make: Callable[[str, str], dict[str, object]]) -> Loader:
    """A loader whose arguments are made for each (task, split), as where files are found or fetched first."""
    return lambda task, split: loader(**make(task, split))


def standard_loaders(tables: Tables, folder: str = "", settings: Settings | None = None, *, mode: str = "fail") -> dict[str, Loader]:
    """A loader, (task, split) -> records, for each corpus of the catalog.

    ``folder``: where pictures lie. ``settings``: how many annotations, regions and questions a record has, and the window of
    traces. In test splits every question is a record. ``mode``: see ``loaders``.
    """
    s = settings or Settings()
    path, numbered = L.in_folder(folder), L.coco_path(folder)

    def own(corpus: str, load: Callable[[str, str, dict[str, DataFrame]], DataFrame]) -> Loader:
        def run(task: str, split: str) -> DataFrame:
            if split not in SPLITS:
                raise ValueError(f"no split {split}")
            return load(task, split, tables(corpus, split))

        return run

    many = lambda split: 1 if split in _TESTS else s.annotations_per_image
    all_or_one = lambda split: 1 if split in _TESTS else None
    shown = lambda split: "test" if split in _TESTS else split

    def genome(task: str, split: str, t: dict[str, DataFrame]) -> DataFrame:
        if task == "vqa":
            return L.visual_genome_qa(t["images"], t["validation_ids"], split, path, most=s.regions_per_chunk)
        if task == "relationship_detection":
            return L.visual_genome_relations(t["images"], t["validation_ids"], split, path, most=s.regions_per_chunk)
        return L.visual_genome_regions(t["images"], t["validation_ids"], split, path, task=task, most=s.regions_per_chunk)

    def seven(task: str, split: str, t: dict[str, DataFrame]) -> DataFrame:
        boxes = t["boxes"] if task == "grounded_multiple_choice_vqa" else None
        return L.visual7w(t["images"], shown(split), path, boxes=boxes, per_turn=s.questions_per_turn)

    def referred(corpus: str) -> Loader:
        return own(corpus, lambda _, split, t: L.refcoco(t["images"], t["regions"], t["expressions"], shown(split), path, source=corpus, mode=mode))

    def polled(kind: str) -> Loader:
        return own(f"pope_{kind}", lambda _, __, t: L.pope(t["questions"], kind, path, mode=mode))

    return {
        "vqa_v2": own("vqa_v2", lambda _, split, t: L.vqa_v2(t["questions"], None if split in _TESTS else t["answers"], numbered, most=s.annotations_per_image, mode=mode)),
        "gqa": own("gqa", lambda _, split, t: L.gqa(t["questions"], path, most=many(split))),
        "text_vqa": own("text_vqa", lambda _, split, t: L.text_vqa(t["questions"], t["ocr"], path, most=all_or_one(split), mode=mode)),
        "text_caps": own("text_caps", lambda _, __, t: L.text_caps(t["captions"], t["ocr"], path)),
        "coco": own("coco", lambda _, split, t: L.coco(t["images"], split, numbered)),
        "docvqa": own("docvqa", lambda _, split, t: L.docvqa(t["questions"], path, most=all_or_one(split))),
        "infographics_vqa": own("infographics_vqa", lambda _, split, t: L.infographics_vqa(t["questions"], path, most=all_or_one(split))),
        "ocr_vqa": own("ocr_vqa", lambda _, split, t: L.ocr_vqa(t["books"], t["keep"], shown(split), path, mode=mode)),
        "vizwiz_vqa": own("vizwiz_vqa", lambda _, __, t: L.vizwiz(t["questions"], path)),
        "aok_vqa": own("aok_vqa", lambda _, __, t: L.aok_vqa(t["questions"], numbered)),
        "ai2d": own("ai2d", lambda _, split, t: L.ai2d(t["images"], t["annotations"], t["test_ids"], shown(split), path)),
        "visual7w": own("visual7w", seven),
        **{c: referred(c) for c in ("refcoco", "refcoco_plus", "refcocog")},
        "visual_genome": own("visual_genome", genome),
        "grit": own("grit", lambda _, __, t: L.grit(t["pictures"], mode=mode)),
        "llava_pretrain": own("llava_pretrain", lambda _, __, t: L.llava_pretrain(t["annotations"], t["details"], path, mode=mode)),
        "llava_instruct": own("llava_instruct", lambda _, __, t: L.llava_instruct(t["conversations"], path)),
        **{f"pope_{k}": polled(k) for k in ("adversarial", "popular", "random")},
        "vsr": own("vsr", lambda _, __, t: L.vsr(t["rows"], path)),
        "nocaps": own("nocaps", lambda _, __, t: L.nocaps(t["rows"], path)),
        "localized_narratives": own("localized_narratives", lambda _, __, t: L.localized_narratives(t["rows"], path, window=s.segment_window)),
    }


def write_subset(records: DataFrame, path: str, settings: Settings | None = None, *, partitions: tuple[str, ...] = ("source",)) -> None:
    """Records of a subset with the settings' number of rows in a file."""
    write_records(records, path, partitions=partitions, rows_per_file=(settings or Settings()).rows_per_file)
