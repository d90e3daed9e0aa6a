x286