"""What recognises and what translates: interfaces, adapters and stand-ins.

A backend is a small picklable object. ``load`` runs once in each Python worker
and returns a function over a batch. The stand-ins are for tests: what they give
is no translation and no OCR. Nothing falls back to them: an adapter whose
libraries are missing raises an error.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from glotspark.functions.text import bounded, halves


class Recognizer(Protocol):
    def load(self) -> Callable[[list[bytes]], list[list[dict]]]:
        """A function from images to spans in reading order: text, conf, line
        (its number), left, top, width, height."""


class Translator(Protocol):
    def load(self) -> Callable[[list[str], str, str], list[str]]:
        """A function from texts, source and target language to texts."""


def _needed(*names: str):
    try:
        return [importlib.import_module(n) for n in names]
    except ImportError as e:
        raise RuntimeError(f"this backend needs {', '.join(names)} on every executor: {e}") from e


@dataclass(frozen=True)
class Tesseract:
    """OCR by tesseract. Not run where this repository is tested: it isn't there."""

    languages: str = "eng"
    config: str = ""

    def load(self):
        tesseract, image = _needed("pytesseract", "PIL.Image")
        import io

        def run(contents: list[bytes]) -> list[list[dict]]:
            out = []
            for content in contents:
                # one entry for each word; block, paragraph and line numbers tell its line
                found = tesseract.image_to_data(image.open(io.BytesIO(content)), lang=self.languages, config=self.config, output_type=tesseract.Output.DICT)
                rows, numbers = [], {}
                for i, word in enumerate(found["text"]):
                    if str(word).strip():
                        place = tuple(found[c][i] for c in ("page_num", "block_num", "par_num", "line_num"))
                        rows.append({"text": str(word), "conf": float(found["conf"][i]), "line": numbers.setdefault(place, len(numbers)), **{c: int(found[c][i]) for c in ("left", "top", "width", "height")}})
                out.append(rows)
            return out

        return run


@dataclass(frozen=True)
class M2M100:
    """Translation by a multilingual model, by default the 418M one; revision: of
    fine-tuned weights. Not run where this repository is tested.

    A text of more than ``longest`` tokens is translated in pieces and put
    together with the white space between them. A piece whose translation doesn't
    end within ``longest_output`` tokens is cut in two; a single character that
    is still too long, before or after translation, is an error. Nothing is cut
    off. The model sees ``batch`` pieces at a time."""

    name: str = "facebook/m2m100_418M"
    revision: str | None = None
    longest: int = 512
    longest_output: int = 1000
    batch: int = 32

    def load(self):
        transformers, torch = _needed("transformers", "torch")
        tokenizer = transformers.M2M100Tokenizer.from_pretrained(self.name, revision=self.revision)
        model = transformers.M2M100ForConditionalGeneration.from_pretrained(self.name, revision=self.revision).eval()

        def size(text: str) -> int:
            return len(tokenizer(text)["input_ids"])

        def ended(ids: list[int]) -> bool:
            """The first token starts the decoder and is the end token too. An
            end in the last place may have been forced."""
            return tokenizer.eos_token_id in ids[1 : self.longest_output]

        def whole(pieces: list[str], target: str) -> list[str]:
            out = []
            for at in range(0, len(pieces), self.batch):
                some = pieces[at : at + self.batch]
                with torch.no_grad():
                    made = model.generate(**tokenizer(some, return_tensors="pt", padding=True), forced_bos_token_id=tokenizer.get_lang_id(target), max_new_tokens=self.longest_output)
                for piece, text, ids in zip(some, tokenizer.batch_decode(made, skip_special_tokens=True), made.tolist(), strict=True):
                    if not ended(ids):
                        if len(piece) < 2:
                            raise ValueError(f"the translation of {piece!r} doesn't end within {self.longest_output} tokens")
                        text = joined(list(halves(piece)), target)
                    out.append(text)
            return out

        def joined(pieces: list[str], target: str) -> str:
            """The model drops the white space around a piece, so it stays outside."""
            bare = [p.strip() for p in pieces]
            done = iter(whole([b for b in bare if b], target))
            return "".join(p.replace(b, next(done), 1) if b else p for p, b in zip(pieces, bare, strict=True))

        def run(texts: list[str], source: str, target: str) -> list[str]:
            tokenizer.src_lang = source
            cut = [bounded(t, size, self.longest) for t in texts]
            short = iter(whole([p[0] for p in cut if len(p) == 1], target))
            return [next(short) if len(p) == 1 else joined(p, target) for p in cut]

        return run


@dataclass(frozen=True)
class Marked:
    """Stand-in for a translator: the text after a mark of its direction."""

    def load(self):
        return lambda texts, source, target: [f"[{source}>{target}] {t}" for t in texts]


@dataclass(frozen=True)
class PlainText:
    """Stand-in for a recogniser: the image is UTF-8 text, a span for each line."""

    line_height: int = 16
    extra: dict = field(default_factory=dict)

    def load(self):
        def spans(content: bytes) -> list[dict]:
            rows = content.decode("utf-8", "replace").split("\n")
            return [{"text": t, "conf": 100.0, "line": i, "left": 0, "top": i * self.line_height, "width": 8 * len(t), "height": self.line_height} for i, t in enumerate(rows)]

        return lambda contents: [spans(c) for c in contents]
