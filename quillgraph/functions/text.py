"""Column functions over text: stripping, line and section classes, mentions, captions, equations.

Patterns follow Python's re on str; `java` gives a pattern the Java flags that agree with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections, in the order in which they are tried, with the patterns that name them.
SECTIONS = (
    ("abstract", r"\babstract\b"),
    ("introduction", r"\bintroduction\b"),
    ("related_work", r"\brelated\s+work\b"),
    ("methodology", r"\b(method(ology)?|approach|proposed)\b"),
    ("experiments", r"\b(experiments?|experimental\s+setup)\b"),
    ("results", r"\b(results?|findings)\b"),
    ("evaluation", r"\bevaluation\b"),
    ("discussion", r"\bdiscussion\b"),
    ("conclusion", r"\bconclusion\b"),
    ("references", r"\breferences?\b"),
)

#: What a line must hold for any of the patterns to be found in it; lines without are settled by one search.
SECTION_STEMS = ("abstract", "introduction", "related", "method", "approach", "proposed", "experiment", "result", "findings", "evaluation", "discussion", "conclusion", "reference")

# Names of data sets; the first alternative that fits counts.
DATASETS = (
    "ImageNet", r"ImageNet[-\s]?1[Kk]", r"ImageNet[-\s]?21[Kk]", "COCO", r"MS[-\s]?COCO", r"Pascal\s*VOC", r"VOC\s*20\d{2}",
    r"CIFAR[-\s]?\d+", "MNIST", r"Fashion[-\s]?MNIST", "ADE20[Kk]", "Cityscapes", "KITTI", "nuScenes", r"Places\d*", r"SUN\d*", "LFW",
    "CelebA", "FFHQ", r"LAION[-\s]?\d*[BM]?", r"CC\d+[BM]?", r"Kinetics[-\s]?\d*", r"UCF\d*", r"HMDB\d*", r"NYU[-\s]?Depth", "ScanNet",
    "ShapeNet", r"ModelNet\d*", "OpenImages", "Objects365", "LVIS", r"SQuAD[\s\d\.]*", "GLUE", "SuperGLUE", r"WikiText[-\s]?\d*",
    r"Common\s*Crawl", "BookCorpus", r"WMT[-\s]?\d{2,4}", r"IWSLT[-\s]?\d{2,4}", r"Penn\s+Treebank", r"CoNLL[-\s]?\d{2,4}", "SNLI",
    "MultiNLI", r"SST[-\s]?\d*", "IMDB", r"MS\s*MARCO", r"Natural\s*Questions", "TriviaQA", "OpenWebText", "RedPajama", "Pile",
    r"VQA[\s\dv\.]*", "GQA", r"OK[-\s]?VQA", "RefCOCO", r"Flickr\d*[Ck]?",
)

# Names of methods and models; the first alternative that fits counts.
METHODS = (
    "Transformer", r"Attention\s+Is\s+All", "ViT", r"Vision\s+Transformer", "DeiT", r"Swin\s*Transformer", r"Swin[-\s]?[BSLT]", "BERT",
    "RoBERTa", "DeBERTa", "ALBERT", "XLNet", "ELECTRA", r"GPT[-\s]?\d*", r"GPT[-\s]?[A-Z]+", "ChatGPT", "T5", r"T5[-\s]?\w+", "mT5", "BART",
    "PEGASUS", r"LLaMA[-\s]?\d*", r"Llama[-\s]?\d*", "Alpaca", "Vicuna", "Mistral", "CLIP", "ALIGN", r"BLIP[-\s]?\d*", "Flamingo",
    r"DALL[-\s]?E[\s\d]*", r"Stable\s+Diffusion", "Midjourney", r"ResNet[-\s]?\d*", r"ResNeXt[-\s]?\d*", r"VGG[-\s]?\d*", "AlexNet", "ZFNet",
    r"EfficientNet[-\s]?\w*", "EfficientDet", r"DenseNet[-\s]?\d*", r"MobileNet[-\s]?[Vv]\d*", r"InceptionV?\d*", "Xception", "NASNet",
    r"RegNet[-\s]?\w*", r"ConvNeXt[-\s]?\w*", r"YOLO[-\s]?[Vv]?\d*", r"YOLOv\d+", r"Faster\s*R[-\s]?CNN", r"Mask\s*R[-\s]?CNN", "RetinaNet",
    "DETR", r"Deformable\s*DETR", "UNet", r"U[-\s]?Net", "SegNet", "FCN", r"DeepLab[-\s]?[Vv]\d*", "SAM", r"Segment\s+Anything", "SimCLR",
    r"MoCo[-\s]?[Vv]?\d*", "BYOL", "DINO", r"DINOv\d*", "MAE", "BEiT", "SimMIM", "NAT", r"Neighborhood\s+Attention",
    r"Dilated\s+.*Attention", r"Window\s+Attention", r"Shifted\s+Window", "CAM", r"Grad[-\s]?CAM", r"Score[-\s]?CAM", "DDPM", "DDIM",
    r"Score[-\s]?SDE", "GAN", r"StyleGAN[-\s]?\d*", "BigGAN", "CycleGAN", "Pix2Pix",
)

# Names of metrics; the first alternative that fits counts.
METRICS = (
    "accuracy", r"top[-\s]?\d+\s+accuracy", "mAP", r"mean\s+average\s+precision", r"AP\d*", r"AP[@\s]\d+", "mIoU", r"mean\s+IoU", "IoU",
    "FID", "IS", r"Inception\s+Score", r"BLEU[-\s]?\d*", r"ROUGE[-\s]?\w*", "METEOR", "CIDEr", "SPICE", r"F1[-\s]?score", r"F[-\s]?score",
    "precision", "recall", "perplexity", "PSNR", "SSIM", "LPIPS", "WER", "CER", "TER", r"AUC[-\s]?ROC?", "ROC", "throughput", "latency",
    "FPS", "GFLOPs", "FLOPs", "params",
)

# How lines of a page are told apart.
LINE_CAPTION = r"^\s*(figure|fig\.?|table|tab\.?)\s*\d+"
LINE_TITLE = r"^\s*(\d+\.?\s+)?(abstract|introduction|related\s+work|methodology|method|approach|experiments?|results?|evaluation|discussion|conclusion|references?|appendix)\b"
LINE_FORMULA = r"[=∑∫∂∇⊕⊗∈∉∀∃←→⟨⟩αβγδεζηθλμνξπρσφψω]|\\[a-zA-Z]+\{|_\{|\^\{"
CAPTION = r"^(figure|fig\.?|fig\s+|table\s+|tab\.?\s*)\s*(\d+[a-z]?)[:\.\s]"
CAPTION_NUMBER = r"^(figure|fig\.?|fig\s+|table|tab\.?)\s*(\d+[a-z]?)"
#: The branch "\frac" stands for a form feed and "rac".
LATEX = r"\\[a-zA-Z]+\{|_\{|\^\{|\frac|\\sum|\\int|\\partial"
# Words that make a table a benchmark, found anywhere in its headers.
BENCHMARK_WORDS = ("accuracy", "f1", "bleu", "rouge", "precision", "recall", "perplexity", "map", "auc", "score", "wer", "cer", "fid")

# Kinds of raw elements; anything else is text.
RAW_TYPES = {
    "Title": "title", "Header": "title", "NarrativeText": "text", "ListItem": "text", "UncategorizedText": "text", "Table": "table",
    "Formula": "equation", "Image": "figure", "FigureCaption": "caption", "Caption": "caption", "Footer": "skip", "PageBreak": "skip", "PageNumber": "skip",
}


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern as Java needs it to treat it as Python does: Unicode classes and case, only \\n ends lines, and all letters and numerals in words."""
    word = r"[\p{L}\p{N}_]"
    told = pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))").replace(r"\w", word)
    return ("(?iUd)" if ignore_case else "(?Ud)") + told


def py_strip(c: Column) -> Column:
    """str.strip(): all Unicode white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_space(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def word_count(c: Column) -> Column:
    """Tokens between white space, as str.split() gives them."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def raw_type_kind(raw_type: Column) -> Column:
    """F1."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RAW_TYPES.items() for x in kv]), raw_type), F.lit("text"))


def section_of(text: Column) -> Column:
    """the first section whose pattern is found, else body."""
    some = text.rlike(java("|".join(SECTION_STEMS)))
    return reduce(lambda c, s: c.when(text.rlike(java(s[1])), s[0]), SECTIONS, F.when(~some, "body")).otherwise("body")


def line_type(line: Column) -> Column:
    """the class of a stripped line."""
    return (
        F.when(line.rlike(java(LINE_CAPTION)), "FigureCaption")
        .when(line.rlike(java(LINE_TITLE)) & (F.length(line) < 80), "Title")
        .when(line.rlike(java(LINE_FORMULA, ignore_case=False)) & (F.length(line) < 200), "Formula")
        .otherwise("NarrativeText")
    )


def keeps_text(text: Column) -> Column:
    """long enough and not like an entry of a bibliography."""
    return (F.length(text) >= 15) & ~text.rlike(java(r"^\[\d+\]", False)) & ~text.rlike(java(r"^\d+\.\s+[A-Z]", False))


def mention_pattern(names: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(names) + r")\b"


def mentions(text: Column, names: tuple[str, ...], longer_than: int) -> Column:
    """Sorted distinct mentions."""
    found = F.transform(F.regexp_extract_all(text, F.lit(java(mention_pattern(names))), F.lit(0)), py_strip)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > longer_than)))


def entity_map(text: Column, ner: Callable[[Column], Column] | None = None) -> Column:
    """E5: mentions by category; empty categories are left out.

    ner: a hook for named entities (E4), from text to a map of category to names; it gets the first 100,000
    characters, and only names of more than two characters are kept, sorted and distinct.
    """
    made = F.create_map(F.lit("datasets"), mentions(text, DATASETS, 2), F.lit("methods"), mentions(text, METHODS, 2), F.lit("metrics"), mentions(text, METRICS, 1))
    if ner is not None:
        clean = lambda k, v: F.array_sort(F.array_distinct(F.filter(F.transform(v, py_strip), lambda x: F.length(x) > 2)))
        none = F.create_map().cast("map<string,array<string>>")
        made = F.map_concat(made, F.when(F.length(text) > 5, F.coalesce(F.transform_values(ner(F.substring(text, 1, 100_000)), clean), none)).otherwise(none))
    return F.map_filter(made, lambda k, v: F.size(v) > 0)


def is_caption(text: Column) -> Column:
    """G-C1."""
    return py_strip(text).rlike(java(CAPTION))


def caption_number(text: Column) -> Column:
    """G-C2: such as 'Figure 3'; null if there is none."""
    t = py_strip(text)
    kind, number = F.regexp_extract(t, java(CAPTION_NUMBER), 1), F.regexp_extract(t, java(CAPTION_NUMBER), 2)
    return F.when(number != "", F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 100)), F.lit(" "), number))


def equation_text(raw: Column, ocr: Column | None = None) -> Column:
    """Q1: struct(latex, source): recognised LaTeX if given, else the raw text as it is if it looks like LaTeX, else with white space collapsed."""
    kept = F.when(raw.rlike(java(LATEX, False)), F.struct(raw.alias("latex"), F.lit("latex_hint").alias("source"))).otherwise(F.struct(collapse_space(raw).alias("latex"), F.lit("raw_text").alias("source")))
    return kept if ocr is None else F.when(ocr.isNotNull() & (ocr != ""), F.struct(ocr.alias("latex"), F.lit("pix2tex").alias("source"))).otherwise(kept)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
