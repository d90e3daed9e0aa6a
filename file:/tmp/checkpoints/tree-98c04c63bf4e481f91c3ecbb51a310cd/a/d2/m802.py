x802