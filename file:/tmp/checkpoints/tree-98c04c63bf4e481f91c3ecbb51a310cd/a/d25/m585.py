x585