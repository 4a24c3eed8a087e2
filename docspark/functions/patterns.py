"""Patterns of footers and page numbers (fixed values)."""

from __future__ import annotations

#: Footers that go wherever they stand; names of a publication can be added.
PAGE_FOOTER = r"(?iu)^\s*(?:trang\s+)?\d+\s*/\s*\d+\s*(?:[-–—|]\s*mã\s+đề(?:\s+thi)?\s+{word}+)?\s*$"
#: Footers that go near the end of a page.
GENERIC_FOOTER = r"(?iu)^\s*(?:#\s*(?=(?:\D*\d){6})[{letters}-]+|(?:isbn|issn)\s*[:#]?\s*[\dXx-]{8,}|(?:mã|số)\s+(?:xuất bản|đăng ký xuất bản|giấy phép)\s*[:#-]?\s*[{letters}./-]+|(?:trang|page)\s+\d{1,4}(?:\s*/\s*\d{1,4})?)\s*$"
PAGE_NUMBER = r"^\s*(?:[-–—~*•\s]+\d{1,4}[-–—~*•\s]+|\[\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*\]|(?:\*\*)?[-–—]?\s*\d{1,4}\s*[-–—]?(?:\*\*)?)\s*$"
PAGE_MARKER = r"(?i)^\s*<!--\s*Page\s+\d+\s*-->\s*$"
SHORT_NUMBER = r"^\s*(?:\*\*)?\d{1,3}(?:\*\*)?\s*$"
#: A line that belongs to a figure, not to what stands about it.
CAPTION = r"(?i)^\s*(?:hình|ảnh|figure|nguồn\s*:)"


def java(pattern: str) -> str:
    """A pattern for Spark's expressions."""
    return pattern.replace("{word}", r"[\p{L}\p{N}_]").replace("{letters}", r"\p{L}\p{N}_")


def python(pattern: str) -> str:
    """A pattern for Python, where a word's letters are Unicode's anyway."""
    return pattern.replace("(?iu)", "(?i)").replace("{word}", r"\w").replace("{letters}", r"\w")
