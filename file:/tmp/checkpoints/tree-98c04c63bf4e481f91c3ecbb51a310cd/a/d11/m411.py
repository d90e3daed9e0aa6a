x411