x946