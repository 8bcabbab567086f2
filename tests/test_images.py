"""Image files: scan with suffix rule, JVM decode, luma, hashes, folder
dedupe (SRC1, SRC2, FN20-FN25, PRJ4, OP6)."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from dupstream.functions import imagehash as IH
from dupstream.operators import stats as ST
from dupstream.sources import images as IM


def write_png(path, pixels: np.ndarray):
    """Minimal PNG writer: 8-bit gray (h, w) or RGB (h, w, 3)."""
    h, w = pixels.shape[:2]
    color = 0 if pixels.ndim == 2 else 2
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    path.write_bytes(png)


def gradient(h=40, w=48):
    return np.tile(np.linspace(0, 255, w), (h, 1)).astype(np.uint8)


def test_hash_kernels():
    flat = np.full((30, 30), 77, np.uint8)
    assert IH.ahash_bits(flat, 8).sum() == 0
    assert IH.bits_to_words(IH.dhash_h_bits(gradient(), 8)) == [-1]
    assert IH.bits_to_words(IH.dhash_v_bits(gradient().T.copy(), 8)) == [-1]
    inv = 255 - gradient()
    assert IH.dhash_h_bits(inv, 16).sum() == 0
    assert IH.luma(np.array([[[0, 0, 255]]], np.uint8))[0, 0] == (19595 * 255 + 32768) >> 16


def test_files_decode_and_fingerprint(spark, tmp_path):
    d = tmp_path / "pics"
    (d / "sub").mkdir(parents=True)
    g = gradient()
    write_png(d / "a.png", g)
    write_png(d / "sub" / "b.png", g)                       # same image, other folder
    write_png(d / "c.png", np.dstack([g, g, g]))             # RGB version (gray-equal)
    write_png(d / "d.PNG", 255 - g)                          # upper-case suffix
    (d / "broken.png").write_bytes(b"not an image")
    (d / "notes.txt").write_text("x")
    files = IM.image_files(spark, str(d), (".png",))
    names = sorted(r["path"].rsplit("/", 1)[1] for r in files.collect())
    assert names == ["a.png", "b.png", "broken.png", "c.png"]     # case-sensitive suffix
    assert IM.image_files(spark, str(d)).count() == 6
    dec = IM.decoded_images(spark, str(d))
    assert dec.count() == 4                                      # broken file dropped
    fp = IM.fingerprint_images(dec)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in fp.collect()}
    assert rows["a.png"]["dhash_h_1"] == rows["b.png"]["dhash_h_1"] == rows["c.png"]["dhash_h_1"] == -1
    assert rows["d.PNG"]["dhash_h_1"] == 0
    assert len(rows["a.png"]["vector768"]) == 768
    # OP6: folder dedupe groups a.png, sub/b.png and c.png by every hash kind
    with_id = fp.withColumn("id", F.xxhash64("path"))
    groups = ST.hash_groups(with_id).collect()
    # rows of a horizontal gradient are constant downwards: the inverted image
    # shares the all-zero vertical dHash
    assert sorted(r["n"] for r in groups) == [3, 3, 4]
    # PRJ4: animated files keep only their digest
    anim = spark.createDataFrame([(p, p.endswith("c.png")) for p in [r["path"] for r in files.collect()]],
                                 "path string, animated boolean")
    post = {r["path"].rsplit("/", 1)[1]: r for r in IM.post_fingerprints(files, fp, anim).collect()}
    assert post["c.png"]["bits"] == 0 and post["c.png"]["ahash_1"] == 0
    assert post["a.png"]["similarity"] and post["broken.png"]["bits"] == 0


def test_folder_duplicates(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    g = gradient()
    write_png(d / "x.png", g)
    write_png(d / "y.png", g)
    write_png(d / "z.jpg.png", np.dstack([255 - g] * 3))
    rows = IM.folder_duplicates(spark, str(d), (".png",)).collect()
    found = {}
    for r in rows:
        found.setdefault((r["kind"], r["h1"], r["h2"], r["h3"], r["h4"]), []).append(r["path"].rsplit("/", 1)[1])
        assert r["n"] == len([x for x in rows if x["kind"] == r["kind"] and x["h1"] == r["h1"]])
    # the inverted image shares the all-zero vertical dHash
    assert sorted(map(sorted, found.values())) == [["x.png", "y.png"], ["x.png", "y.png"], ["x.png", "y.png", "z.jpg.png"]]


def test_stacks_hash_like_single_images_and_plain_resampling():
    rng = np.random.default_rng(3)
    for h, w in ((8, 8), (40, 30), (17, 65)):
        stack = rng.integers(0, 256, (7, h, w)).astype(np.uint8)
        got = IH.fingerprints(stack)
        for i, gray in enumerate(stack):
            one = IH.fingerprints(gray[None])
            assert all((one[k][0] == got[k][i]).all() for k in got)
            assert got["words"][i].tolist() == [*IH.bits_to_words(IH.ahash_bits(gray, 16)), *IH.bits_to_words(IH.dhash_h_bits(gray, 16)),
                                                *IH.bits_to_words(IH.dhash_v_bits(gray, 16))]
            plain = np.zeros((16, w))
            for y in range(16):                      # plain weighted sums, level by level
                plain[y] = gray.T.astype(float) @ IH._weights(h, 16)[y]
            assert np.abs(IH.resize(gray, w, 16).astype(float) - np.clip(plain, 0, 255)).max() <= 1
    bits = rng.integers(0, 2, (3, 128))
    for row, packed in zip(bits, IH.pack_words(bits)):
        text = "".join(map(str, row))
        assert [int(text[:64], 2), int(text[64:], 2)] == [int(x) % 2**64 for x in packed]


def test_images_of_mixed_sizes_keep_their_order(monkeypatch):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, s).astype(np.uint8) for s in ((9, 9), (30, 20), (9, 9), (20, 30), (9, 9))]
    whole = IM._hashed(list("abcde"), images)
    monkeypatch.setattr(IM, "STACK_BYTES", 1)
    assert IM._hashed(list("abcde"), images).equals(whole)
    assert IM._hashed([], []).num_rows == 0
    assert whole.column("ahash_1").to_pylist() == [
        int(IH.fingerprints(g[None])["words"][0][0]) for g in images]
