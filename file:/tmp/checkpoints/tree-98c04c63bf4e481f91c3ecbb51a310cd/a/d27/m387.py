x387