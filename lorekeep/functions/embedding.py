"""Text to vectors: a local ONNX model."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from ..errors import EmbeddingError

BATCH = 32
DIMENSIONS = {"BAAI/bge-small-zh-v1.5": 512}  # fixed values


class OnnxEmbedder:
    """A sentence model in a folder (model.onnx, tokenizer.json): the first token's state, normalised."""

    def __init__(self, folder: Path | str, model: str):
        self.folder, self.model, self.dimensions = str(folder), model, DIMENSIONS[model]
        self._session = self._tokenizer = None

    def _load(self) -> None:
        try:
            import onnxruntime
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            self._tokenizer.enable_truncation(512)
            self._tokenizer.enable_padding()
            self._session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", providers=["CPUExecutionProvider"])
        except Exception as e:  # whatever the libraries raise, queries go on without the model
            raise EmbeddingError(f"cannot load {self.model}: {e}") from e

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None, "_tokenizer": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._session is None:
            self._load()
        out = []
        for at in range(0, len(texts), BATCH):
            coded = self._tokenizer.encode_batch(texts[at : at + BATCH])
            given = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
            names = {i.name for i in self._session.get_inputs()}
            state = self._session.run(None, {k: np.array(v, dtype=np.int64) for k, v in given.items() if k in names})[0][:, 0]
            out += (state / np.linalg.norm(state, axis=1, keepdims=True)).tolist()
        return out


def embedder(model: str | None, folder: Path | str):
    return None if model is None else OnnxEmbedder(Path(folder) / "models" / model.replace("/", "--"), model)
