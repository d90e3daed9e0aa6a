x364