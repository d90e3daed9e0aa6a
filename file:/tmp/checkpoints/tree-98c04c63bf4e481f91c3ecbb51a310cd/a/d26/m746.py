x746