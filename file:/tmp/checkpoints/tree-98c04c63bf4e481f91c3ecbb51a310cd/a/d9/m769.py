x769