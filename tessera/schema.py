"""Schemas and fixed values of the image tables."""

from __future__ import annotations

#: The ITU-T T.81 zigzag order, natural index of each place in the stream.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)

MAX_FILE = 16 * 1024 * 1024
MAX_DECODED = 32 * 1024 * 1024
#: Cycles a second of the accelerator whose counters are converted.
CYCLES_PER_SECOND = 800e6 / 3

FILES = "file_index int, path string, length long, content binary"
COMPONENT = "struct<id:int,h:int,v:int,tq:int,td:int,ta:int>"
TABLE = "struct<counts:array<int>,symbols:array<int>>"
HEADER = (
    "file_index int, path string, valid boolean, error string, width int, height int, n_comp int, restart_interval int, ss int, se int, ah int, al int, "
    f"comps array<{COMPONENT}>, qt map<int,array<int>>, dc_ht map<int,{TABLE}>, ac_ht map<int,{TABLE}>, "
    "mcu_w int, mcu_h int, mcu_w_real int, mcu_h_real int, max_h int, max_v int, bmp_padding int, data_start int, warnings int, nonstandard boolean, decoded_bytes long"
)
MARKERS = "file_index int, seq int, code int, offset int, length int"
COEFFS = "file_index int, brow int, bcol int, comp int, scan_idx int, restart_seg int, zz array<int>, q array<int>, max_h int, max_v int, width int, height int, error string"
IMAGES = "file_index int, path string, width int, height int, rgb binary, error string, elapsed_s double, blocks int"
QUALITY = (
    "image string, corrupted boolean, ssim_r double, ssim_g double, ssim_b double, ssim double, psnr_r double, psnr_g double, psnr_b double, psnr double, "
    "ref_path string, out_path string, reason string"
)
