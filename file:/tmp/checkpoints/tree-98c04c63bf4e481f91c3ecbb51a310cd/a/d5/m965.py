x965