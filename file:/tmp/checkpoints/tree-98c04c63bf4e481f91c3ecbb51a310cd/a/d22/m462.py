x462