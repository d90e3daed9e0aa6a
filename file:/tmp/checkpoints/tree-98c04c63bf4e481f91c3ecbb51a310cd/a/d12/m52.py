x52