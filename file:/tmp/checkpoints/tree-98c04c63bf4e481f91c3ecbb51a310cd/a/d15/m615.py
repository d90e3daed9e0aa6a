x615