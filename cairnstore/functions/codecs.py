"""Compression of solid groups: zstd with optional dictionary, LZMA2 with tuned parameters, raw."""

from __future__ import annotations

import lzma
from dataclasses import dataclass

from cairnstore.functions.scalars import MODES


@dataclass(frozen=True)
class Frame:
    codec: str
    payload: bytes


def dictionary_bytes(n: int) -> int:
    mib = 1 << 20
    return 2 * mib if n < 4 * mib else 4 * mib if n < 16 * mib else 16 * mib


def compress(data: bytes, mode: str, dictionary: bytes | None = None) -> Frame:
    """A frame of one group. `text` asks for the strongest codec at hand, which here is LZMA2 tuned for text."""
    _, codec, level, _ = MODES[mode]
    if codec == "zstd":
        import zstandard

        plain = zstandard.ZstdCompressor(level=level).compress(data)
        if dictionary:
            known = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(data)
            if len(known) < len(plain):
                return Frame("zstd+dict", known)
        return Frame("zstd", plain)
    tries = [(4, 0)] if mode == "text" else _parameters(data)
    return Frame("xz", min((_xz(data, lc, pb) for lc, pb in tries), key=len))


# Fixed values in here: the pairs of literal-context and position bits that are tried.
def _parameters(data: bytes) -> list[tuple[int, int]]:
    """Literal-context and position bits to try in full: tuned on a strided sample for data of 256 KiB and more."""
    if len(data) < 256 << 10:
        return [(3, 2)]
    if len(data) <= 1 << 20:
        sample = data
    else:
        segment = 1 << 17
        stride = (len(data) - segment) // 7
        sample = b"".join(data[k * stride : k * stride + segment] for k in range(8))
    ranked = sorted(((len(_xz(sample, lc, pb)), k, lc, pb) for k, (lc, pb) in enumerate([(4, 4), (3, 4), (4, 2), (4, 3)])))
    best = ranked[0]
    return list(dict.fromkeys([(best[2], best[3]), (best[2], 2)]))


def _xz(data: bytes, lc: int, pb: int) -> bytes:
    filters = [{"id": lzma.FILTER_LZMA2, "preset": 9, "lc": min(lc, 4), "lp": 0, "pb": pb, "nice_len": 64, "dict_size": dictionary_bytes(len(data))}]
    return lzma.compress(data, format=lzma.FORMAT_XZ, filters=filters)


def decompress(frame: Frame, most: int, dictionary: bytes | None = None) -> bytes:
    """The group again; ValueError if it is broken or larger than ``most``."""
    try:
        if frame.codec == "raw":
            out = frame.payload
        elif frame.codec.startswith("zstd"):
            import zstandard

            known = zstandard.ZstdCompressionDict(dictionary) if frame.codec == "zstd+dict" and dictionary else None
            if zstandard.frame_content_size(frame.payload) > most:
                raise ValueError("declared larger than its chunks")
            out = zstandard.ZstdDecompressor(dict_data=known).decompress(frame.payload, max_output_size=most)
        else:
            out = lzma.LZMADecompressor(memlimit=1 << 30).decompress(frame.payload, max_length=most + 1)
    except (lzma.LZMAError, EOFError) as e:
        raise ValueError(f"broken frame: {e}") from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise ValueError(f"broken frame: {e}") from e
        raise
    if len(out) > most:
        raise ValueError("larger than its chunks")
    return out


def pays(dictionary: bytes | None, groups: list[bytes], mode: str) -> bool:
    """Whether groups shrink by more than the dictionary takes."""
    if not dictionary:
        return False
    plain = sum(len(compress(g, mode).payload) for g in groups)
    known = sum(len(compress(g, mode, dictionary).payload) for g in groups)
    return plain - known > len(dictionary)


def store_raw(codec: str, size: int, gate: int, entropy: float, limit: float = 7.95) -> bool:
    """Whether a chunk is kept as it is: what is empty, and by codec what the gate or its entropy show to be random."""
    if size == 0:
        return True
    if codec == "zstd":
        return False
    return entropy > limit and (codec == "cm" or gate >= size)


def gate_size(data: bytes) -> int:
    """A fast codec's size, to compare candidates by; by entropy where that codec is not there."""
    try:
        import zstandard
    except ImportError:
        from cairnstore.functions.transforms import entropy

        return int(entropy(data) * len(data) / 8)
    return len(zstandard.ZstdCompressor(level=3).compress(data))


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes | None:
    """A zstd dictionary from samples of a bounded total; null for fewer than four."""
    import zstandard

    if len(samples) < 4:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None
