"""Elevations of points from image tiles: each tile that is needed is decoded once.

Points are reduced to the distinct pixels they need, at most 65,536 a tile however many points
lie there; a tile meets its pixels in one grouped call, and heights go back to the points by a
join. A tile's image is 24 or 32 bits a pixel, 256 pixels a side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchback.functions import geo

ZOOM = 14
SIDE = 256


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (rows, columns, channels) of an 8-bit RGB or RGBA image that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only plain 8-bit RGB and RGBA images are read")
    width, height, channels = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a row above and a column in front of zeros
    for y in range(height):
        line, above = raw[y, 1:].reshape(width, channels).astype(np.int64), out[y, 1:]
        how = raw[y, 0]
        if how == 0:
            out[y + 1, 1:] = line
        elif how == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) % 256
        elif how == 2:
            out[y + 1, 1:] = (line + above) % 256
        else:
            for x in range(width):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y + 1, x + 1] = (line[x] + guess) % 256
    return out[1:, 1:]


def pixels(points: DataFrame, key: str, bilinear: bool, zoom: int = ZOOM) -> DataFrame:
    """(key, x, y, px, py, weight): the pixels that give each point's height; one, or up to four around it with bilinear weights."""
    n = float(SIDE << zoom)
    gx = (F.col("lng") + 180) / 360 * n
    rad = F.radians(F.col("lat"))
    gy = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / float(np.pi)) / 2 * n
    if not bilinear:
        t = geo.tile("lat", "lng", zoom)
        return points.select(key, t.alias("t")).select(key, "t.x", "t.y", "t.px", "t.py", F.lit(1.0).alias("weight"))
    p = points.select(key, (gx - 0.5).alias("gx"), (gy - 0.5).alias("gy"))
    x0, y0 = F.floor("gx"), F.floor("gy")
    fx, fy = F.col("gx") - x0, F.col("gy") - y0
    four = F.array(*[F.struct((x0 + i).alias("x"), (y0 + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for j in (0, 1) for i in (0, 1)])
    p = p.select(key, F.explode(four).alias("c"))
    inside = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.lit(int(n) - 1).cast("long"), F.col(c)))
    p = p.select(key, inside("c.x").alias("x"), inside("c.y").alias("y"), F.col("c.w").alias("weight"))
    cell = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    return p.select(key, cell("x").alias("x"), cell("y").alias("y"), (F.col("x") % SIDE).cast("int").alias("px"), (F.col("y") % SIDE).cast("int").alias("py"), "weight")


def tile_heights(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """(x, y, px, py, z) of distinct pixels (x, y, px, py) from tiles (x, y, data); a tile that doesn't decode, or is missing, gives none."""

    def read(pix: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(tile) or not len(pix):
            return pix.iloc[:0].assign(z=0.0)
        try:
            rgb = decode_png(bytes(tile["data"].iloc[0]))
        except (ValueError, zlib.error, struct.error):
            return pix.iloc[:0].assign(z=0.0)
        at = rgb[pix["py"].to_numpy(), pix["px"].to_numpy()]
        return pix.assign(z=at[:, 0] * 256.0 + at[:, 1] + at[:, 2] / 256.0 - 32768.0)

    one = tiles.join(wanted.select("x", "y").distinct(), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("data").alias("data"))
    return wanted.groupBy("x", "y").cogroup(one.groupBy("x", "y")).applyInPandas(read, "x int, y int, px int, py int, z double")


def profile(points: DataFrame, tiles: DataFrame, line: str = "route_id", seq: str = "seq", bilinear: bool = False, zoom: int = ZOOM) -> DataFrame:
    """(line, seq, z) of lines' points (line, seq, lat, lng); a line with a point that no tile gives a height, or of one point, has no rows.

    So what is written is a whole profile or none.
    """
    p = points.select(F.struct(line, seq).alias("__k"), "lat", "lng")
    pix = pixels(p, "__k", bilinear, zoom)
    heights = tile_heights(pix.select("x", "y", "px", "py").distinct(), tiles)
    got = pix.join(heights, ["x", "y", "px", "py"]).groupBy("__k").agg(F.sum(F.col("z") * F.col("weight")).alias("z"), F.sum("weight").alias("w"))
    z = p.join(got.where("w > 1 - 1e-9"), "__k", "left").select(F.col(f"__k.{line}").alias(line), F.col(f"__k.{seq}").alias(seq), "z")
    whole = z.groupBy(line).agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("m")).where("n = m and n > 1").select(line)
    return z.join(whole, line, "left_semi")
