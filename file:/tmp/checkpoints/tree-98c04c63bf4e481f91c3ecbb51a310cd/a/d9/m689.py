x689