x406