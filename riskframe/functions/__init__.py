"""Row-wise feature expressions."""
