x265