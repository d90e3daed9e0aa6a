x663