x704