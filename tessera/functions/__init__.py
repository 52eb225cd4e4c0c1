"""Column-level functions (JVM-side expressions, no Python per row)."""

from tessera.functions.hashing import seeded_md5, hash32, hash_unit, hash_bucket
from tessera.functions.columns import (
    first_picture, picture_name, parse_int_strict, label_from_path, has_extension,
    one_hot, scale_pixels, is_header, parse_gpu_util, parse_gpu_mem, memory_percent,
    ms_to_minutes, epoch_ms, leaky_relu, softmax, predict_index, mcxent, mcxent_logits,
    round_array,
)
from tessera.functions.pixels import (
    flip_left_right, flip_top_bottom, rotate180, rotate270, rotate90, permute_pixels,
)

__all__ = [
    "seeded_md5", "hash32", "hash_unit", "hash_bucket",
    "first_picture", "picture_name", "parse_int_strict", "label_from_path", "has_extension",
    "one_hot", "scale_pixels", "is_header", "parse_gpu_util", "parse_gpu_mem", "memory_percent",
    "ms_to_minutes", "epoch_ms", "leaky_relu", "softmax", "predict_index", "mcxent", "mcxent_logits",
    "round_array", "flip_left_right", "flip_top_bottom", "rotate180", "rotate270", "rotate90",
    "permute_pixels",
]
