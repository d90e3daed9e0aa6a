x445