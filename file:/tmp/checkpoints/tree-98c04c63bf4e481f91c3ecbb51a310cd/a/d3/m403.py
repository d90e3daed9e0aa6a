x403