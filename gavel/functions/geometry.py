"""Block types of packed weights: elements and bytes of a block."""

from __future__ import annotations

from dataclasses import dataclass

# File ids, elements of a block, bytes of a block.
TYPES = {
    "F32": (0, 1, 4), "F16": (1, 1, 2), "Q4_0": (2, 32, 18), "Q4_1": (3, 32, 20), "Q5_0": (6, 32, 22), "Q5_1": (7, 32, 24), "Q8_0": (8, 32, 34), "Q8_1": (9, 32, 36),
    "Q2_K": (10, 256, 84), "Q3_K": (11, 256, 110), "Q4_K": (12, 256, 144), "Q5_K": (13, 256, 176), "Q6_K": (14, 256, 210), "Q8_K": (15, 256, 292),
    "IQ2_XXS": (16, 256, 66), "IQ2_XS": (17, 256, 74), "IQ3_XXS": (18, 256, 98), "IQ1_S": (19, 256, 50), "IQ4_NL": (20, 32, 18), "IQ3_S": (21, 256, 110), "IQ2_S": (22, 256, 82), "IQ4_XS": (23, 256, 136),
    "I8": (24, 1, 1), "I16": (25, 1, 2), "I32": (26, 1, 4), "I64": (27, 1, 8), "F64": (28, 1, 8), "IQ1_M": (29, 256, 56), "BF16": (30, 1, 2), "TQ1_0": (34, 256, 54), "TQ2_0": (35, 256, 66), "MXFP4": (39, 32, 17),
}
#: Types with an integer dot product, those of them with an offset, and the zero points of packed products.
INTEGER = ("Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1")
OFFSET = ("Q4_1", "Q5_1")
ZERO_POINT = {"Q4_0": 8, "Q4_1": 0, "Q5_0": 16, "Q5_1": 0, "Q8_0": 128}


@dataclass(frozen=True)
class BlockType:
    name: str
    code: int
    elements: int
    size: int

    @property
    def quantized(self) -> bool:
        return self.elements > 1

    def row_bytes(self, n: int) -> int:
        if n % self.elements:
            raise ValueError(f"{self.name} rows must be a multiple of {self.elements} elements; got {n}")
        return n // self.elements * self.size


BY_NAME = {k: BlockType(k, *v) for k, v in TYPES.items()}
BY_CODE = {t.code: t for t in BY_NAME.values()}


def parse(name: str) -> BlockType | None:
    """By name, upper or lower case."""
    return BY_NAME.get(name.upper())
