"""Writes small E57 files for tests: scans with any point fields, cut into packets that split records."""

import struct

import numpy as np

from cloudloom.sources import e57


def packed(values, low, bits):
    """Values less ``low`` as a stream of ``bits`` each, from the low bit."""
    whole = 0
    for i, v in enumerate(values):
        whole |= (int(v) - low) << (i * bits)
    return whole.to_bytes(-(-len(values) * bits // 8), "little")


def e57_file(scans, packet_bytes=200, page=1024):
    """``scans``: dicts of fields ({name: (kind, values, attributes)}), and pose (w, x, y, z, tx, ty, tz) or None."""
    own, logical, about = page - 4, bytearray(48), []
    for scan in scans:
        while len(logical) % 4:
            logical.append(0)
        at, streams, xml, n = len(logical), [], [], 0
        for name, (kind, values, extra) in scan["fields"].items():
            n = len(values)
            if kind in ("single", "double"):
                streams.append(np.asarray(values, "<f4" if kind == "single" else "<f8").tobytes())
                xml.append(f'<{name} type="Float" precision="{kind}"/>')
                continue
            low, high = extra["minimum"], extra["maximum"]
            bits = (high - low).bit_length()
            streams.append(packed(values, low, bits) if bits else b"")
            xml.append(f'<{name} type="{kind}" ' + " ".join(f'{k}="{v}"' for k, v in extra.items()) + "/>")
        logical += bytes(32)
        data = len(logical)
        left = list(streams)
        turn = 0
        while any(left):
            sizes = [min(len(x), packet_bytes + 7 * ((turn + k) % 3)) for k, x in enumerate(left)]
            body = b"".join(x[:s] for x, s in zip(left, sizes, strict=True))
            left = [x[s:] for x, s in zip(left, sizes, strict=True)]
            size = -(-(6 + 2 * len(sizes) + len(body)) // 4) * 4
            packet = struct.pack("<BBHH", 1, 0, size - 1, len(sizes)) + struct.pack(f"<{len(sizes)}H", *sizes) + body
            logical += packet + bytes(size - len(packet))
            if turn == 0:
                logical += struct.pack("<BBHHB9x", 0, 0, 31, 1, 0) + struct.pack("<QQ", 0, 0)  # an index packet, to be passed over
                logical += struct.pack("<BBH", 2, 0, 3)  # and an empty one
            turn += 1
        struct.pack_into("<B7xQQQ", logical, at, 1, len(logical) - at, data, 0)
        about.append((at, data, n, "".join(xml), scan.get("pose")))
    physical = lambda at: at // own * page + at % own
    parts = []
    for at, data, n, xml, pose in about:
        struct.pack_into("<Q", logical, at + 16, physical(data))
        where = ""
        if pose:
            where = "<pose><rotation>" + "".join(f'<{c} type="Float">{v}</{c}>' for c, v in zip("wxyz", pose[:4], strict=True)) + "</rotation><translation>"
            where += "".join(f'<{c} type="Float">{v}</{c}>' for c, v in zip("xyz", pose[4:], strict=True)) + "</translation></pose>"
        parts.append(f'<vectorChild type="Structure">{where}<points type="CompressedVector" fileOffset="{physical(at)}" recordCount="{n}"><prototype type="Structure">{xml}</prototype><codecs type="Vector"/></points></vectorChild>')
    text = ('<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><data3D type="Vector">' + "".join(parts) + "</data3D></e57Root>").encode()
    xml_at = len(logical)
    logical += text
    pages = -(-len(logical) // own)
    struct.pack_into("<8sIIQQQQ", logical, 0, b"ASTM-E57", 1, 0, pages * page, physical(xml_at), len(text), page)
    logical += bytes(pages * own - len(logical))
    rows = np.frombuffer(bytes(logical), np.uint8).reshape(pages, own)
    return np.hstack([rows, e57.crc32c(rows).astype(">u4").view(np.uint8).reshape(pages, 4)]).tobytes()
