x428