"""Stand-ins for renderers, recognisers and models: plain text as pages and words, rules as a model."""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

from paperloom.plans.ingestion import Providers
from paperloom.sources.providers import ImagePages, Unavailable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class TextPages(ImagePages):
    """Plain text drawn as pages of bars, one a word; other files as in the library."""

    def pages(self, kind: str, content: bytes) -> list[np.ndarray]:
        if kind == "txt":
            words = TextWords().words(kind, content)
            out = []
            for page in range(1, max((w["page"] for w in words), default=1) + 1):
                own = [w for w in words if w["page"] == page]
                image = np.full((30 + max((w["y"] for w in own), default=0), 20 + max((w["x"] + w["width"] for w in own), default=0), 3), 255, np.uint8)
                for w in words:
                    if w["page"] == page:
                        image[w["y"] : w["y"] + w["height"] : 2, w["x"] : w["x"] + w["width"]] = 0
                out.append(image)
            return out
        return super().pages(kind, content)


@dataclass
class TextWords:
    """Words of plain text with boxes made from their places; 40 lines are a page. Other files need recognition."""

    confidence: float = 95.0

    def words(self, kind: str, content: bytes) -> list[dict]:
        if kind != "txt":
            raise Unavailable(f"no recogniser for {kind} files is configured")
        out = []
        for i, line in enumerate(content.decode("utf-8", "replace").split("\n")):
            x = 10
            for text in line.split():
                out.append({"page": 1 + i // 40, "word_idx": len(out), "text": text, "confidence": self.confidence, "x": x, "y": 10 + 20 * (i % 40), "width": 8 * len(text), "height": 12, "block_num": 0, "par_num": 0, "line_num": i})
                x += 8 * len(text) + 8
        return out


@dataclass
class LabelModel:
    """Answers by rule: the type by words of the text, fields by lines of the form 'label: value'."""

    words: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"invoice": ("invoice",), "payslip": ("payslip", "net pay"), "id_proof": ("passport", "identity"), "bank_statement": ("statement", "iban")})

    def complete(self, prompt: str) -> str:
        head, _, text = prompt.partition("\n\n")
        if head.startswith("Name the type"):
            low = text.lower()
            return next((t for t, words in self.words.items() if any(w in low for w in words)), "other")
        if "give how surely" in head:
            return json.dumps({line.split(": ")[0]: 0.9 for line in head.split("\n")[2:] if ": " in line})
        fields = {re.sub(r"\W+", "_", k.strip().lower()).strip("_"): v.strip() for k, v in re.findall(r"^([A-Za-z][\w ]{0,40}):[ \t]*(.*)$", text, re.M)}
        rows = [dict(zip(("description", "amount"), r, strict=True)) for r in re.findall(r"^\* (.+?) \| (.+)$", text, re.M)]
        return json.dumps({"fields": {k: v or None for k, v in fields.items()}, "tables": [{"table_name": "line_items", "rows": rows}] if rows else []})


def providers() -> Providers:
    return Providers(TextWords(), LabelModel(), TextPages())
