"""ICC profiles: tags as values, tone curves, and the transform from one matrix profile to another."""

from __future__ import annotations

import struct

import numpy as np

from tessera.kernels import carriers, text


def tags(profile: bytes) -> dict[str, bytes]:
    return {sign: body for _, sign, _, body in carriers.icc_tags(profile)}


def tag_text(body: bytes) -> str | None:
    """Text of text, description, localised and signature tags."""
    kind = body[:4]
    if kind == b"text":
        return body[8:].split(b"\0")[0].decode("utf-8", "replace")
    if kind == b"desc" and len(body) >= 12:
        size = struct.unpack_from(">I", body, 8)[0]
        return body[12 : 12 + size].split(b"\0")[0].decode("utf-8", "replace")
    if kind == b"mluc":
        return text.mluc_text(text.mluc_read(body))
    if kind == b"sig ":
        return body[8:12].decode("latin-1")
    return None


def fixed(raw: bytes) -> np.ndarray:
    """s15Fixed16 numbers."""
    return np.frombuffer(raw[: len(raw) // 4 * 4], ">i4") / 65536


def to_fixed(values) -> bytes:
    return np.round(np.asarray(values, float) * 65536).astype(">i4").tobytes()


def tag_numbers(body: bytes) -> list[float]:
    """Numbers of XYZ and sf32 tags, u16Fixed16 and integers of others."""
    kind = body[:4]
    if kind in (b"XYZ ", b"sf32"):
        return fixed(body[8:]).tolist()
    if kind == b"uf32":
        return (np.frombuffer(body[8 : 8 + (len(body) - 8) // 4 * 4], ">u4") / 65536).tolist()
    wide = {b"ui08": 1, b"ui16": 2, b"ui32": 4, b"ui64": 8}.get(kind)
    return np.frombuffer(body[8 : 8 + (len(body) - 8) // wide * wide], f">u{wide}").astype(float).tolist() if wide else []


def xyz_tag(*values: float) -> bytes:
    return b"XYZ " + bytes(4) + to_fixed(values)


def gamma_tag(gamma: float) -> bytes:
    return b"curv" + bytes(4) + struct.pack(">IH", 1, round(gamma * 256))


def sampled_tag(values) -> bytes:
    return b"curv" + bytes(4) + struct.pack(">I", len(values)) + np.round(np.clip(values, 0, 1) * 65535).astype(">u2").tobytes()


def parametric_tag(kind: int, *parameters: float) -> bytes:
    return b"para" + bytes(4) + struct.pack(">HH", kind, 0) + to_fixed(parameters)


def curve(body: bytes):
    """The function of a tone curve: identity, a power, samples with lines between, or one of five formulas; None if it is none."""
    if body[:4] == b"curv" and len(body) >= 12:
        count = struct.unpack_from(">I", body, 8)[0]
        if count == 0:
            return lambda x: np.asarray(x, float)
        points = np.frombuffer(body[12 : 12 + 2 * count], ">u2")
        if len(points) < count:
            return None
        if count == 1:
            gamma = points[0] / 256
            return lambda x: np.power(np.clip(x, 0, None), gamma)
        return lambda x: np.interp(x, np.linspace(0, 1, count), points / 65535)
    if body[:4] == b"para" and len(body) >= 12:
        kind = struct.unpack_from(">H", body, 8)[0]
        need = (1, 3, 4, 5, 7)
        p = fixed(body[12:]).tolist()
        if kind > 4 or len(p) < need[kind]:
            return None
        g, a, b, c, d, e, f = [*p[: need[kind]], *[0.0] * (7 - need[kind])]
        if kind == 0:
            return lambda x: np.power(np.clip(x, 0, None), g)
        if kind == 1:
            low, split, more, line = 0.0, -b / a if a else 0.0, 0.0, (0.0, 0.0)
        elif kind == 2:
            low, split, more, line = c, -b / a if a else 0.0, c, (0.0, c)
        elif kind == 3:
            low, split, more, line = 0.0, d, 0.0, (c, 0.0)
        else:
            low, split, more, line = 0.0, d, e, (c, f)
        return lambda x: np.where(np.asarray(x, float) >= split, np.power(np.clip(a * np.asarray(x, float) + b, 0, None), g) + more, line[0] * np.asarray(x, float) + line[1])
    return None


def multiply(a, b) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(b, float)


def invert(a) -> np.ndarray | None:
    """The inverse of a 3 x 3 matrix, None if it has none to speak of."""
    a = np.asarray(a, float)
    return None if abs(np.linalg.det(a)) < 1e-12 else np.linalg.inv(a)


def matrix(profile: bytes) -> np.ndarray | None:
    """Columns of the colorants of a matrix profile."""
    have = tags(profile)
    if not all(k in have for k in ("rXYZ", "gXYZ", "bXYZ")):
        return None
    columns = [tag_numbers(have[k])[:3] for k in ("rXYZ", "gXYZ", "bXYZ")]
    return np.array(columns).T if all(len(c) == 3 for c in columns) else None


class Transform:
    """RGB pixels of one matrix profile as those of another: 256 entries forward, 4096 samples backward."""

    def __init__(self, source: bytes, target: bytes) -> None:
        a, b = matrix(source), matrix(target)
        back = invert(b) if b is not None else None
        curves = [[curve(tags(p).get(k, b"")) for k in ("rTRC", "gTRC", "bTRC")] for p in (source, target)]
        if a is None or back is None or any(c is None for row in curves for c in row):
            raise ValueError("only profiles of a matrix and tone curves can be transformed")
        self.forward, own = (np.stack([np.clip(c(np.arange(256) / 255), 0, 1) for c in row], 1) for row in curves)
        self.same_curves = bool(np.allclose(self.forward, own, atol=1e-4))
        self.matrix = multiply(back, a)
        places = np.linspace(0, 1, 4096)
        ends = np.linspace(0, 1, 4096)
        self.back = np.stack([np.interp(ends, np.maximum.accumulate(np.clip(c(places), 0, 1)), places) for c in curves[1]], 1)

    @property
    def identity(self) -> bool:
        return self.same_curves and bool(np.allclose(self.matrix, np.eye(3), atol=1e-4))

    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        light = np.stack([self.forward[pixels[..., k], k] for k in range(3)], -1)
        out = np.clip(light @ self.matrix.T, 0, 1)
        at = np.floor(out * 4095 + 0.5).astype(np.int64)
        return np.floor(np.stack([self.back[at[..., k], k] for k in range(3)], -1) * 255 + 0.5).astype(np.uint8)


def supported(source: bytes, target: bytes) -> bool:
    try:
        Transform(source, target)
    except ValueError:
        return False
    return True


def matrix_profile(colorants, gamma: float, description: str = "matrix") -> bytes:
    """A profile of colorants (columns of XYZ) and one power for all channels."""
    header = bytes(12) + b"mntrRGB XYZ " + bytes(12) + b"acsp" + bytes(28) + to_fixed([0.9642, 1.0, 0.8249]) + bytes(48)
    c = np.asarray(colorants, float)
    rows = [("desc", text.mluc_write({"en-US": description})), ("wtpt", xyz_tag(0.9642, 1.0, 0.8249))]
    rows += [(k, xyz_tag(*c[:, i])) for i, k in enumerate(("rXYZ", "gXYZ", "bXYZ"))] + [(k, gamma_tag(gamma)) for k in ("rTRC", "gTRC", "bTRC")]
    return carriers.icc_write(header, rows)
