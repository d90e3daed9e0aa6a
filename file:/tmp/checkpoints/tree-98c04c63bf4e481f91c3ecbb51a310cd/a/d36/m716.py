x716