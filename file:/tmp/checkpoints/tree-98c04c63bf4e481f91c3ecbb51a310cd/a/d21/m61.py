x61