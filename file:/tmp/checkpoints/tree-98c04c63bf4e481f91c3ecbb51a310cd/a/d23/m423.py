x423