"""Where models come in: taggers, language models, text recognisers and summarisers are given, never built in.

A provider is a function without arguments that loads a model and returns a callable; each Python worker calls it
once, on its first row. Without a provider every step has the result of an absent model: patterns only, entities
unchanged, the template sentence. A call that fails costs its own row only, and what failed is a column `warning` (of
tagged pages `ner_warnings`), not a line in a worker's log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import strip
from lethe.operators import verify
from lethe.operators.detect import model_label, token_windows
from lethe.operators.filters import protected, without_tags
from lethe.operators.resolve import CHUNKED, chunks_merged
from lethe.plans.shipping import ensure_shipped

Tagger = Callable[[], Callable[[str], list[dict]]]
Answerer = Callable[[], Callable[[str], str]]

class Registry:
    """Named providers, of which one is active; a name that is not there leaves the active one."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable] = {}
        self.active: str | None = None

    def add(self, name: str, loader: Callable) -> None:
        self._loaders[name] = loader
        self.active = self.active or name

    def use(self, name: str) -> None:
        if name in self._loaders:
            self.active = name

    def available(self) -> list[str]:
        return sorted(self._loaders)

    def loader(self) -> Callable | None:
        return self._loaders.get(self.active) if self.active else None


TAGS = "array<struct<label:string,score:double,start:int,end:int>>"


def tagged(pages: DataFrame, tagger: Tagger | None, threshold: float = C.NER_THRESHOLD) -> DataFrame:
    """Adds `ner`, the model's hits in each page: windows are tagged, labels mapped, weak hits dropped, offsets
    moved to the page and repeats of overlapping windows merged. A window that fails is skipped."""
    none = F.array().cast("array<struct<text:string,start:int,end:int,type:string,score:double>>")
    if tagger is None:
        return pages.withColumn("ner", none).withColumn("ner_warnings", F.array().cast("array<string>"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = None
        for b in batches:
            found, said = [], []
            for text in b["chunk"]:
                model = model or tagger()
                try:
                    found.append([{"label": t["label"], "score": float(t["score"]), "start": int(t["start"]), "end": int(t["end"])} for t in model(text)])
                    said.append(None)
                except Exception as e:  # noqa: BLE001  a failed window leaves the others' hits
                    found.append([])
                    said.append(f"a window was not tagged: {type(e).__name__}")
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_num": b["page_num"], "char_start": b["char_start"], "tags": found, "warning": said})

    ensure_shipped(pages.sparkSession)
    kind = pages.schema["doc_id"].dataType.simpleString()
    windows = pages.select("doc_id", "page_num", F.explode(token_windows(F.coalesce("text", F.lit("")))).alias("w"))
    rows = windows.select("doc_id", "page_num", "w.char_start", F.col("w.text").alias("chunk")).mapInPandas(run, f"doc_id {kind}, page_num int, char_start int, tags {TAGS}, warning string")
    hits = rows.select("doc_id", "page_num", "char_start", "warning", F.explode_outer("tags").alias("t")).filter((F.col("t.score") >= threshold) | F.col("warning").isNotNull())
    hits = hits.join(pages.select("doc_id", "page_num", "text"), ["doc_id", "page_num"])
    start, end = F.col("char_start") + F.col("t.start"), F.col("char_start") + F.col("t.end")
    hit = F.struct((-F.col("t.score")).alias("neg_score"), start.alias("i"), start.alias("start"), end.alias("end"), F.expr("substring(text, char_start + t.start + 1, t.end - t.start)").alias("text"), model_label(F.col("t.label")).alias("type"), F.col("t.score").alias("score"))
    per = hits.groupBy("doc_id", "page_num").agg(F.collect_list(F.when(F.col("warning").isNull(), hit)).cast(f"array<{CHUNKED}>").alias("l"), F.sort_array(F.collect_list("warning")).alias("ner_warnings"))
    kept = F.transform(chunks_merged(F.col("l")), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["score"].alias("score")))
    out = pages.join(per.select("doc_id", "page_num", kept.alias("ner"), "ner_warnings"), ["doc_id", "page_num"], "left")
    return out.withColumn("ner", F.coalesce("ner", none)).withColumn("ner_warnings", F.coalesce("ner_warnings", F.array().cast("array<string>")))


CONTEXTS = {
    "insurance": "policy, claim and agent details and the people insured", "medical": "patient and case numbers, staff, diagnoses and dates of treatment",
    "police": "case and badge numbers, officers, witnesses, suspects and places", "tax": "tax and social numbers, income and employers", "government": "file numbers, citizens' numbers and officials", "general": "",
}


HINT = "The document's kind asks for care with "
DETECT_ASK = 'List the personal data in the text as JSON: {"entities": [{"text": ..., "type": ..., "start": ...}]}. Copy each text exactly.\n'


def prompts(ents: DataFrame, pages: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """doc_id, prompt for each document with entities that a model may dispute: one call for a document."""
    asked = ents.filter(~protected(F.col("source"), F.col("entity_type"), F.col("score")))
    x = verify.entity_lines(asked).join(verify.combined_text(pages), "doc_id")
    x = x.join(types, "doc_id", "left") if types is not None else x.withColumn("doc_type", F.lit("general"))
    hint = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in CONTEXTS.items() for v in kv)), F.col("doc_type")), F.lit(""))
    hint = F.when(hint != "", F.concat(F.lit(HINT), hint, F.lit(".\n"))).otherwise("")
    ask = "For each listed entity answer one line: CONFIRMED - text, or FALSE_POSITIVE - text - reason. Then list missed ones: NEW - TYPE - text.\n"
    return x.select("doc_id", F.concat(hint, F.lit(ask), F.col("lines"), F.lit(f"\n{C.CONTENT_TAGS[0]}\n"), F.col("combined"), F.lit(f"\n{C.CONTENT_TAGS[1]}")).alias("prompt"))


def detect_prompts(pages: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, prompt that asks a model for the entities of each page, of which it reads the first characters."""
    x = pages.join(types, "doc_id", "left") if types is not None else pages.withColumn("doc_type", F.lit("general"))
    hint = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in CONTEXTS.items() for v in kv)), F.col("doc_type")), F.lit(""))
    hint = F.when(hint != "", F.concat(F.lit(HINT), hint, F.lit(".\n"))).otherwise("")
    body = without_tags(F.substring(F.coalesce("text", F.lit("")), 1, C.PAGE_CHARS))
    return x.select("doc_id", "page_num", F.concat(hint, F.lit(DETECT_ASK), F.lit(f"{C.CONTENT_TAGS[0]}\n"), body, F.lit(f"\n{C.CONTENT_TAGS[1]}")).alias("prompt"))


def answered(asked: DataFrame, answerer: Answerer) -> DataFrame:
    """doc_id, raw, warning: the model's answers; null where it failed, with what failed."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = None
        for b in batches:
            out, said = [], []
            for p in b["prompt"]:
                model = model or answerer()
                try:
                    out.append(model(p))
                    said.append(None)
                except Exception as e:  # noqa: BLE001  the document keeps its entities
                    out.append(None)
                    said.append(f"a prompt was not answered: {type(e).__name__}")
            yield pd.DataFrame({"doc_id": b["doc_id"], "raw": out, "warning": said})

    ensure_shipped(asked.sparkSession)
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"doc_id {kind}, raw string, warning string")


def verified_documents(ents: DataFrame, pages: DataFrame, answerer: Answerer | None, types: DataFrame | None = None) -> DataFrame:
    """Entities after a model's verdicts and with its additions. Without a model they are unchanged; documents
    without disputable entities are not asked about, and one whose call failed keeps its own."""
    if answerer is None:
        return ents
    answers = answered(prompts(ents, pages, types), answerer).filter("raw IS NOT NULL")
    own = protected(F.col("source"), F.col("entity_type"), F.col("score"))
    asked = ents.filter(~own).join(answers.select("doc_id"), "doc_id", "left_semi")
    rest = ents.filter(own).unionByName(ents.filter(~own).join(answers.select("doc_id"), "doc_id", "left_anti"))
    new = verify.additions(verify.new_entities(answers), pages, ents)
    return rest.unionByName(verify.verified(asked, verify.verdicts(answers))).unionByName(new.select(*ents.columns))


def classified(pages: DataFrame, answerer: Answerer | None) -> DataFrame:
    """doc_id, doc_type; general without a model or an answer."""
    texts = verify.classify_text(pages)
    if answerer is None:
        return texts.select("doc_id", F.lit("general").alias("doc_type"))
    ask = "Answer with one word, the document's kind: " + ", ".join(C.DOC_TYPES) + ".\n"
    asked = texts.select("doc_id", F.concat(F.lit(f"{ask}{C.CONTENT_TAGS[0]}\n"), F.col("text"), F.lit(f"\n{C.CONTENT_TAGS[1]}")).alias("prompt"))
    return answered(asked, answerer).select("doc_id", F.coalesce(verify.doc_type(F.col("raw")), F.lit("general")).alias("doc_type"))


def reworded(risks: DataFrame, answerer: Answerer | None) -> DataFrame:
    """Risk summaries with a model's sentence where it is one: over ten characters and no apology."""
    if answerer is None:
        return risks
    ask = F.concat(F.lit("Rewrite as one natural sentence: "), F.col("sentence"))
    said = answered(risks.select("doc_id", ask.alias("prompt")), answerer).withColumn("raw", strip(F.col("raw")))
    good = (F.length("raw") > 10) & ~F.lower("raw").contains("sorry")
    return risks.join(said, "doc_id", "left").withColumn("sentence", F.when(good, F.col("raw")).otherwise(F.col("sentence"))).drop("raw", "warning")


def language(pages: DataFrame, detector: Answerer | None) -> DataFrame:
    """Adds lang: short texts, an absent detector and its errors give en; it reads the first 2000 characters."""
    short = F.length(strip(F.coalesce("text", F.lit("")))) < 20
    if detector is None:
        return pages.withColumn("lang", F.lit("en"))
    asked = pages.filter(~short).select("doc_id", "page_num", F.substring("text", 1, C.CLASSIFY_CHARS).alias("prompt"))
    keyed = asked.select(F.struct("doc_id", "page_num").alias("k"), "prompt")
    found = answered(keyed.select(F.to_json("k").alias("doc_id"), "prompt"), detector).select(F.col("doc_id").alias("k"), F.col("raw").alias("lang"))
    x = pages.withColumn("k", F.to_json(F.struct("doc_id", "page_num"))).join(found, "k", "left").drop("k")
    return x.withColumn("lang", F.coalesce("lang", F.lit("en")))


def recognised(images: DataFrame, engines: list[Callable]) -> DataFrame:
    """doc_id, page_num, text, warning of images (doc_id, page_num, content): the first engine that reads something; empty
    without any."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        loaded: list = []
        for b in batches:
            loaded = loaded or [e() for e in engines]
            texts, said = [], []
            for content in b["content"]:
                text, failed = "", []
                for read in loaded:
                    try:
                        text = (read(content) or "").strip()
                    except Exception as e:  # noqa: BLE001  the next engine has a try
                        failed.append(f"an image was not read: {type(e).__name__}")
                    if text:
                        break
                texts.append(text)
                said.append("; ".join(failed) or None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_num": b["page_num"], "text": texts, "warning": said})

    ensure_shipped(images.sparkSession)
    kind = images.schema["doc_id"].dataType.simpleString()
    return images.select("doc_id", "page_num", "content").mapInPandas(run, f"doc_id {kind}, page_num int, text string, warning string")


def read_pages(pages: DataFrame, engines: list[Callable]) -> DataFrame:
    """Pages (doc_id, page_num, text, content): only those without a text layer are recognised."""
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0
    read = recognised(pages.filter(blank), engines).withColumn("is_ocr", F.lit(True))
    return pages.filter(~blank).select("doc_id", "page_num", "text", F.lit(False).alias("is_ocr"), F.lit(None).cast("string").alias("warning")).unionByName(read)
