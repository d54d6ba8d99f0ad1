"""Column functions over frames."""

from chunkwise.functions.codec import compress, decompress, easy_compress, get_items, status
from chunkwise.functions.header import header, metainfo, sizes, validate

__all__ = ["compress", "decompress", "easy_compress", "get_items", "header", "metainfo", "sizes", "status", "validate"]
