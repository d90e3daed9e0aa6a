x262