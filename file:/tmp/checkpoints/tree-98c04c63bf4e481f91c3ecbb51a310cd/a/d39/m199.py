x199