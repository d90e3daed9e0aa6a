x370